"""Key-value state as a fold of an operation log ``(seq, scope, key, op, value, default, delta)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.operators.ordered import CHUNK, GROUP_ROWS, chunked, largest_group


def scoped_key(scope: Column, key: Column) -> Column:
    """Job state carries the job's name in front of the key; without a scope the key is shared."""
    return F.when(scope.isNull(), key).otherwise(F.concat(scope, F.lit(":"), key))


def whole_number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def current_values(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Value of every key after its last set or delete; deleted keys are left out. Combined before the shuffle."""
    keys = keys or ["key"]
    last = log.where(F.col("op").isin("set", "delete")).groupBy(*keys).agg(F.max(F.struct("seq", "op", "value")).alias("last"))
    return last.where("last.op = 'set'").select(*keys, F.col("last.value").alias("value"))


def folded(log: DataFrame, keys: list[str] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Value of every key after sets, deletes and increments.

    An increment adds to the number the key holds. A key that is absent, or holds something that is not a number, takes
    the increment's own default first. Each piece of a key is reduced alone: its last set or delete, the increments
    after it, and the default of the first of those. The pieces of a key are then put together in order.
    """
    keys = keys or ["key"]
    biggest, total = largest_group(log, keys)
    pieces = log.withColumn(CHUNK, F.lit(0)) if biggest <= group_rows else chunked(log, keys, ["seq"], group_rows, total)

    resets = F.when(F.col("op").isin("set", "delete"), F.col("seq"))
    local = pieces.withColumn("_reset", F.max(resets).over(Window.partitionBy(*keys, CHUNK)))
    counted = (F.col("op") == "incr") & (F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")))
    parts = local.groupBy(*keys, CHUNK).agg(
        F.max(F.when(F.col("seq") == F.col("_reset"), F.struct("seq", "op", "value"))).alias("reset"),
        F.sum(F.when(counted, F.col("delta"))).alias("added"),
        F.min(F.when(counted, F.struct("seq", "default"))).alias("first"),
    )
    last_reset = F.max(F.when(F.col("reset").isNotNull(), F.col(CHUNK))).over(Window.partitionBy(*keys))
    after = parts.withColumn("_from", last_reset).where(F.col("_from").isNull() | (F.col(CHUNK) >= F.col("_from")))
    merged = after.groupBy(*keys).agg(
        F.max("reset").alias("reset"), F.sum("added").alias("added"), F.min("first").alias("first")
    )
    held = F.when(F.col("reset.op") == "set", F.col("reset.value"))
    number = F.coalesce(whole_number(held), F.col("first.default")) + F.col("added")
    value = F.when(F.col("first").isNull(), held).otherwise(number.cast("string"))
    return merged.select(*keys, value.alias("value")).where(F.col("value").isNotNull())


def snapshot(state: DataFrame, scope: str | None = None) -> DataFrame:
    """All keys, or those of one scope."""
    return state if scope is None else state.where(F.startswith("key", F.lit(f"{scope}:")))
