"""Documents that hold benchmark items: size-partitioned MinHash containment search with exact verification.

An item is much smaller than a document, so similarity of whole sets says nothing. Instead an item is represented by
the shingles with its smallest hashes, and a document is asked for them. Items are partitioned by size, and the size
fixes how many minima are taken: one more than may be missing at the threshold, so that every document that contains
enough of an item holds one of its minima at least. Candidates are then verified on all shingles of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.session import durable, small

#: Characters that are no part of a word.
BETWEEN = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


def shingle_hashes(of: Column, width: int) -> Column:
    """Hashes of the ``width``-word runs in the array ``of``; none where it is shorter."""

    def runs(w: Column) -> Column:
        last = F.size(w) - width
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))).otherwise(F.array().cast("array<long>"))

    return F.flatten(F.transform(F.array(of), runs))  # the outer transform computes the words once


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item, wide, shingle, n): distinct shingles per distinct item, their number, and their width, which is that of
    the whole item where it has fewer than ``width`` words."""
    cut = items.select("item", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("wide", F.least(F.size("w"), F.lit(width)))
    hashed = F.lit(None).cast("array<long>")
    for k in range(1, width + 1):
        hashed = F.when(F.col("wide") == k, shingle_hashes(F.col("w"), k)).otherwise(hashed)
    listed = cut.select("item", "wide", F.array_distinct(hashed).alias("s"))
    return listed.select("item", "wide", F.size("s").alias("n"), F.explode("s").alias("shingle"))


def sketches(shingles: DataFrame, threshold: int) -> DataFrame:
    """The minima that represent every item. Sizes are partitioned by powers of two, and the largest size of a partition
    fixes the number for all its items."""
    at_most = F.least(F.col("n"), F.floor(F.pow(F.lit(2.0), F.ceil(F.log2("n"))) * (100 - threshold) / 100) + 1)
    listed = shingles.groupBy("item", "wide", "n").agg(F.sort_array(F.collect_set("shingle")).alias("s"))
    return listed.select("item", "wide", "n", F.explode(F.slice("s", F.lit(1), at_most.cast("int"))).alias("shingle"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: int = 80, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_found, n_shingles) for every document and item with ``100 * n_found >= threshold * n_shingles``.

    Shingles are runs of ``width`` words, words are runs of letters and digits in lower case; an item with fewer words is
    one shingle, an item without words is in no document. Items of equal shingles are all reported, repeated rows of an
    item once. Rows of one document id count as one document; a null id is reported as such when it is found. Documents
    without words hold nothing. Other columns are not read.
    """
    shingles = durable(item_shingles(items.select(F.col(item_column).alias("item"), F.col(item_text).alias("text")).distinct(), width))
    minima = durable(sketches(shingles, threshold))
    widths = sorted(r[0] for r in shingles.select("wide").distinct().collect())  # at most ``width`` numbers
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def of_documents(rows: DataFrame) -> DataFrame:
        cut = rows.select("id", words(F.col("text")).alias("w"))

        def of_width(k: int) -> Column:
            return F.transform(F.array_distinct(shingle_hashes(F.col("w"), k)), lambda x: F.struct(F.lit(k).alias("wide"), x.alias("shingle")))

        each = [of_width(k) for k in widths]
        return cut.select("id", F.explode(F.concat(*each) if each else F.array().cast("array<struct<wide:int,shingle:long>>")).alias("s")).select("id", "s.wide", "s.shingle")

    asked = small(minima.select("wide", "shingle").distinct())
    hits = of_documents(read).join(asked, ["wide", "shingle"]).distinct()
    candidates = durable(hits.join(minima.select("item", "wide", "shingle"), ["wide", "shingle"]).select("id", "item").distinct())
    named = small(candidates.select(F.col("id").alias("named")).distinct())
    close = read.join(named, F.col("id").eqNullSafe(F.col("named")), "left_semi")
    all_asked = small(shingles.select("wide", "shingle").distinct())
    held = of_documents(close).join(all_asked, ["wide", "shingle"]).distinct()
    counted = held.join(shingles, ["wide", "shingle"]).groupBy("id", "item", "n").agg(F.count("*").alias("n_found")).where(F.col("n_found") * 100 >= F.col("n") * threshold)
    pairs = candidates.select(F.col("id").alias("cid"), F.col("item").alias("citem"))
    return counted.join(pairs, F.col("id").eqNullSafe(F.col("cid")) & F.col("item").eqNullSafe(F.col("citem")), "left_semi").select(
        F.col("id").alias(id_column), F.col("item").alias(item_column), "n_found", F.col("n").cast("long").alias("n_shingles")
    )
