"""Shards that all hold the mixture of the sources: proportional stratified interleaving.

Rows of a source are put in a seeded random order, a row's rank becomes a fraction of its source, and all rows are
sorted by that fraction; equal cuts of this order hold every source in proportion, to within a row at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pagewatch.session import durable

#: Rows that one sort of a task has at most on average; what comes out does not depend on it.
PIECE_ROWS = 50_000


def offsets(rows: DataFrame, piece: str, by: list[str]) -> DataFrame:
    """Rows in earlier pieces, for every (by, piece). Without ``by`` one task adds up one row per piece."""
    counted = rows.groupBy(*by, piece).agg(F.count("*").alias("n"))
    before = W.partitionBy(*by).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    return counted.select(*by, piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), *([F.sum("n").over(W.partitionBy(*by)).alias("of_source")] if by else []))


def stratified_shards(df: DataFrame, shards: int = 16, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``df``; the law is ``rows``.

    Shard row counts are at most one apart and slots count from 0 without gaps. The order depends on seed, id and text
    alone, so repeated rows share a place in it and take neighbouring slots. A null source is a source of its own, a
    null text has size 1 and checksum 0. A source starts at a seeded offset below one rank, so that very many sources
    of one row spread over all shards. Both rankings are cut into pieces by value, so a source with most of the rows is
    ranked by many tasks. Other columns are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = durable(
        df.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit("")).alias("stratum"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "id", "crc", "size"))
    )
    total = rows.count()
    pieces = max(64, -(-total // piece_rows))
    # The piece is the leading part of the hash, so pieces follow one another in the order of the hash.
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    rows = rows.withColumn("unit", unit).withColumn("piece", F.floor(F.col("unit") * pieces))
    inner = W.partitionBy("stratum", "piece").orderBy("unit", "h", "id")
    ranked = rows.withColumn("rank", F.row_number().over(inner)).join(offsets(rows, "piece", ["stratum"]), ["stratum", "piece"])
    start = (F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1 << 20)) + F.lit(0.5)) / float(1 << 20)
    ranked = ranked.withColumn("fraction", (F.col("before") + F.col("rank") - start) / F.col("of_source")).drop("before", "piece", "of_source")
    ranked = ranked.withColumn("piece", F.floor(F.col("fraction") * pieces))
    placed = W.partitionBy("piece").orderBy("fraction", "stratum", "rank")
    # One row per piece: total / piece_rows of them, of 16 bytes each.
    joined = ranked.withColumn("place", F.row_number().over(placed)).join(F.broadcast(offsets(ranked, "piece", [])), "piece")
    joined = joined.withColumn("place", F.col("before") + F.col("place") - 1).withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        joined.withColumn("slot", F.col("place") - first)
        .select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
