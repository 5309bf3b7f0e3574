"""Running aggregates and numbering along an order, without one task ever owning a hot key.

A window over a key puts all rows of that key into one task. Here the row counts are looked at first: while the
largest key stays below ``group_rows`` the plain window is used (one shuffle). Above it, and always without a key, rows are range
partitioned by (key, order) into pieces of about ``group_rows`` rows, each piece is worked alone, and what a piece
must know about the pieces before it (one row per piece) is added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.session import durable

GROUP_ROWS = 5_000_000
# Pieces that rows are cut into at most, as long as one holds no more than GROUP_ROWS: the driver hears of every piece, and
# of a hundred sampled rows for each.
PIECES = 512
CHUNK = "_chunk"

_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_LOCAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in all); the counts are combined map-side before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n"), F.sum("n")).first()
    return int(top[0] or 0), int(top[1] or 0)


def piece_count(total: int, rows: int, cores: int) -> int:
    """Pieces of about ``rows`` rows, but not ever more of them the more rows there are."""
    return max(1, min(-(-total // rows), max(PIECES, cores, -(-total // GROUP_ROWS))))


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, total: int) -> DataFrame:
    """Rows cut into pieces contiguous in (keys, order); the piece number is stored in the ``_chunk`` column.

    ``order`` must be unique within a key, so that no piece can outgrow its share. Pieces are larger than ``rows`` where
    there would be too many of them.
    """
    pieces = piece_count(total, rows, df.sparkSession.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(pieces, *keys, *order).sortWithinPartitions(*keys, *order)
    return durable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def carried(chunks: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """What earlier pieces of a key contribute to each later piece of it.

    A piece can continue only one key (its first), so there are fewer rows here than pieces: small enough to broadcast.
    """
    parts = chunks.groupBy(*keys, CHUNK).agg(*[_LOCAL[kind](value).alias(name) for name, (kind, value) in columns.items()])
    window = Window.partitionBy(*keys).orderBy(CHUNK)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("_piece", F.row_number().over(window))
        .withColumns({f"_before_{name}": _FOLD[kind](name).over(before) for name, (kind, _) in columns.items()})
        .where("_piece > 1")
        .select(*[F.col(key).alias(f"_key_{key}") for key in keys], F.col(CHUNK).alias("_key_chunk"),
                *[f"_before_{name}" for name in columns])
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, Column]],
    through: bool = True,
    group_rows: int = GROUP_ROWS,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add running ``sum``/``count``/``min``/``max`` columns per key along ``order``.

    ``through`` includes the current row; otherwise only the rows before it count. ``sizes`` passes on what
    ``largest_group`` found, when several runs go over the same rows.
    """
    biggest, total = sizes or largest_group(df, keys)
    last = 0 if through else -1
    if not keys:  # without a key a window would be one task, so there are always pieces
        group_rows = min(group_rows, max(1, -(-total // df.sparkSession.sparkContext.defaultParallelism)))
    if keys and biggest <= group_rows:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({name: _LOCAL[kind](value).over(window) for name, (kind, value) in columns.items()})

    chunks = chunked(df, keys, order, group_rows, total)
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = chunks.withColumns({name: _LOCAL[kind](value).over(window) for name, (kind, value) in columns.items()})
    earlier = carried(chunks, keys, columns)
    same = F.col(CHUNK) == F.col("_key_chunk")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    joined = local.join(F.broadcast(earlier), same, "left")
    return joined.select(*df.columns, *[_merge(kind, name).alias(name) for name, (kind, _) in columns.items()])


def _merge(kind: str, name: str) -> Column:
    here, before = F.col(name), F.col(f"_before_{name}")
    if kind == "min":
        return F.least(here, before)
    if kind == "max":
        return F.greatest(here, before)
    return F.when(here.isNull() & before.isNull(), None).otherwise(
        F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """1-based position of each row within its key (or in the whole table when ``keys`` is empty)."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, group_rows=group_rows)
