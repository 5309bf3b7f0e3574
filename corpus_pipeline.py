"""A pass over a raw corpus, stage by stage; every stage works on all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.llm import decontaminate, language_ppm, minhash_dedup, pieces, secret_scans
from pagewatch.llm.common import held_out, short_batches
from pagewatch.session import durable, shared_folder, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from those that name theirs. Null texts and texts without letters are
    rejected and go; the predicted language is the one kept in ``lang``."""
    short_batches(spark)
    model = language_ppm.learn(docs.where(~held_out(F.col("doc_id"))))
    named = language_ppm.kept(docs.select(COLUMNS), model)
    return named.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, one without id where none has an id.

    Every row is compared by its own text, whatever its id. Texts without words are near to nothing; of those, repeated
    rows go. Rows are known by 128-bit hashes of their columns, so no copy of the texts is made."""
    short_batches(spark)
    whole = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]  # hashes pass over nulls, so these are told
    rows = docs.select(COLUMNS).withColumns({**minhash_dedup.text_keys(), "t1": F.xxhash64(*whole), "t2": F.xxhash64(F.lit(1), *whole)})
    prints = durable(minhash_dedup.fingerprints(rows.select("doc_id", "k1", "k2", "t1", "t2", "text"), 5, minhash_dedup.BANDS, minhash_dedup.ROWS))
    groups = durable(minhash_dedup.similar_sets(rows.select("k1", "k2", "text"), prints, 5, 80))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2")
    first = prints.select("set_key", "doc_id", "t1", "t2").join(groups, "set_key").groupBy("component").agg(F.min(order).alias("first")).select("first.t1", "first.t2")
    kept = durable(first.union(prints.where("set_key IS NULL").select("t1", "t2")).distinct())
    # Rows that are equal in all columns are told apart by nothing: one of them stays.
    repeated = durable(prints.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    several = durable(kept.join(repeated, ["t1", "t2"], "left_semi"))
    # Whole rows meet the keys of those that go or are repeated, which are far fewer than those that stay.
    gone = durable(prints.select("t1", "t2").distinct().join(kept, ["t1", "t2"], "left_anti").union(several))
    left = rows.join(small(gone), ["t1", "t2"], "left_anti").select(COLUMNS)
    return left.union(rows.join(small(several), ["t1", "t2"], "left_semi").select(COLUMNS).dropDuplicates())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Every row is judged by its own text, whatever its id: equal texts are one."""
    own = F.unhex(F.md5(F.col("text").cast("binary")))
    found = decontaminate.contained_items(docs.select(own.alias("own"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="own")
    named = small(found.select(F.col("own").alias("named")).distinct())
    return docs.select(COLUMNS).join(named, own == F.col("named"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    clean = secret_scans.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and checksums of the encoded texts and of their sampled segmentations."""
    short_batches(spark)
    # By now the executors' heaps have grown with the earlier stages, so tasks work on less text at a time.
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), batch_bytes=1 << 18)


STAGES: list[tuple[str, Stage]] = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("segmented", segmented)]
#: Language models and tokenizers are nothing that SQL expresses; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
