"""Item and target filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions.matching import keyword_matches
from pagewatch.functions.text import first_number, price
from pagewatch.operators.extract import with_matches
from pagewatch.session import small
from pagewatch.spec import JobSpec

def field(name: str) -> Column:
    return F.coalesce(F.element_at("fields", F.lit(name)), F.lit(""))


def with_field(fields: Column, name: str, value: Column) -> Column:
    """The field map with one value replaced."""
    return F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), value))


def filtered(items: DataFrame, spec: JobSpec, item_filter: Callable[[DataFrame], DataFrame | None] | Column | None = None) -> DataFrame | None:
    """The filter stage. A custom filter replaces the keyword filter; matches are then read again from its fields. None
    if it answers with nothing."""
    if item_filter is None:
        return with_matches(items.drop("matches"), spec)
    kept = items.where(item_filter) if isinstance(item_filter, Column) else item_filter(items)
    if kept is None:
        return None
    matches = keyword_matches(F.col("fields"), spec.keywords, spec.field_names, spec.search_fields)
    return kept.withColumn("matches", matches)


def response_gate(attempts: DataFrame) -> DataFrame:
    """Only answered attempts with status 200 go on."""
    return attempts.where(F.col("ok") & (F.col("status") == 200))


def not_blocked(items: DataFrame, blocklist: DataFrame, column: Column, key: str) -> DataFrame:
    """Items whose lower-cased ``column`` is not in ``blocklist``; broadcast only if the list is small."""
    listed = small(blocklist.select(F.lower(key).alias("_blocked")).distinct())
    return items.withColumn("_name", F.lower(column)).join(listed, F.col("_name") == F.col("_blocked"), "left_anti").drop("_name")


def has_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def salary_text(text: Column) -> Column:
    """The first number as ``$Nk+``; text without a number is left alone."""
    digits = F.regexp_extract(text, "[0-9]+", 0)
    number = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(digits == "", text).otherwise(F.concat(F.lit("$"), number, F.lit("k+")))


def under_ceiling(text: Column, ceiling: float) -> Column:
    """True unless the price can be read and is above the ceiling."""
    return ~F.coalesce(price(text) > ceiling, F.lit(False))


def first_number_under(text: Column, ceiling: float) -> Column:
    return ~F.coalesce(first_number(text) > ceiling, F.lit(False))


def titled(title: Column) -> Column:
    return title != ""


def enabled(specs: DataFrame) -> DataFrame:
    return specs.where("enabled")


def due(targets: DataFrame, now: Column, last: str = "last_check", interval: str = "interval_sec") -> DataFrame:
    """Targets whose interval has passed; a target never checked is due."""
    return targets.where(now - F.coalesce(F.col(last), F.lit(0)) >= F.col(interval))


def reattached(returned: DataFrame, original: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items a hook gave back, with the matches they had before; items it made up have none."""
    known = original.select(*keys, "matches")
    rows = returned.drop("matches").join(known, list(keys), "left")
    return rows.withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))
