"""SQL over the stored tables, and table changes as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.operators.dedup import first_of_each


def query(spark: SparkSession, sql: str, params: Sequence | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL with ``?`` parameters over the given tables. None binds NULL."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(sql, args=list(params) if params else None)


def same_keys(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def insert(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows, allowMissingColumns=True)


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append the rows whose key is not there yet; of rows with the same key the first in ``order`` is taken."""
    first = first_of_each(rows, keys, order).alias("r")
    fresh = first.join(base.select(*keys).alias("l"), same_keys(keys), "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Changed rows replace the values of base rows of the same key, or are added; each side is shuffled once.

    The latest of several changes (by ``order``) counts. Columns that ``changes`` lacks keep the base value.
    """
    if order is not None:
        row = F.max(F.struct(order, F.struct(*changes.columns).alias("row"))).alias("last")
        changes = changes.groupBy(*keys).agg(row).select("last.row.*")
        changes = changes.drop(order) if order not in base.columns else changes
    marked = changes.withColumn("_changed", F.lit(True))
    joined = base.alias("l").join(marked.alias("r"), same_keys(keys), "full_outer")

    def value(name: str) -> Column:
        if name not in changes.columns:
            return F.col(f"l.{name}")
        return F.when(F.col("_changed"), F.col(f"r.{name}")).otherwise(F.col(f"l.{name}"))

    return joined.select(*[value(name).alias(name) for name in base.columns])


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table after the update, and the rows that were changed, as they are now."""
    hit = F.coalesce(condition, F.lit(False))
    marked = table.withColumn("_hit", hit)
    changed = marked.withColumns({
        name: F.when(F.col("_hit"), value).otherwise(F.col(name)) for name, value in values.items()
    })
    return changed.drop("_hit"), changed.where("_hit").drop("_hit")


def delete_where(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The table after the delete, and the rows that were taken out."""
    hit = F.coalesce(condition, F.lit(False))
    return table.where(~hit), table.where(hit)


def task_rollup(tasks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of tasks per status."""
    return tasks.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("tasks"))


def advance_tasks(tasks: DataFrame, results: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks after a run: completed or failed when there is a result, processing when only claimed."""
    outcome = F.when(F.col("ok"), "completed").when(~F.col("ok"), "failed").otherwise("processing")
    changes = results.select(key, outcome.alias("_outcome"))
    return tasks.join(changes, key, "left").withColumn("status", F.coalesce("_outcome", "status")).drop("_outcome")
