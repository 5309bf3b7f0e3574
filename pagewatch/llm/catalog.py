"""The registered queries of this subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.llm import conversation_repair, decontaminate, embedding_dedup, filter_audit, html_content, language_ppm, minhash_dedup, pieces, pii_crf, quality_mil, secret_scans, sharding, sql, token_counts
from pagewatch.llm.common import held_out, short_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_mil.score(documents, quality_mil.learn(documents, labels.where(~held_out(F.col("doc_id")))))


def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_copies(table(spark, folder, "documents"), width=4, percent=80)


def op5_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, folder, "documents"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, folder, "embeddings"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return language_ppm.predict(documents, language_ppm.learn(documents.where(~held_out(F.col("doc_id")))))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_content.extract(table(spark, folder, "pages"))


def op9_contained_items(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scans.scan(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii_crf.digests(pii_crf.personal_data(table(spark, folder, "documents")))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, folder, "conversations")), copies_column="copies")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality, op2_pieces, op3_minhash_dedup, op4_token_counts, op5_stratified_shards, op6_embedding_dedup, op7_language, op8_main_text, op9_contained_items, op10_secret_scan, op11_filter_audit, op12_personal_data, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op3_minhash_dedup": sql.NEAR_COPIES, "op6_embedding_dedup": sql.NEAR_VECTORS, "op9_contained_items": sql.CONTAINED_ITEMS, "op10_secret_scan": sql.SECRETS, "op11_filter_audit": sql.FILTER_AUDIT}
