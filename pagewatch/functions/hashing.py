"""Content identity of an item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pagewatch.functions.text import is_blank, strip


def _digest(entries: Column) -> Column:
    zero = F.char(F.lit(0))
    parts = F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], zero, e["value"], zero))
    return F.sha2(F.array_join(parts, ""), 256)


def content_hash(fields: Column, hash_fields: Sequence[str] | None = None) -> Column:
    """Hash over the key-sorted fields, or over ``hash_fields`` unless every one of those is blank."""
    everything = _digest(F.map_entries(fields))
    names = [name.strip() for name in hash_fields or [] if name.strip()]
    if not names:
        return everything
    values = [F.coalesce(F.element_at(fields, F.lit(name)), F.lit("")) for name in names]
    chosen = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in zip(names, values)])
    any_filled = F.exists(F.array(*values), lambda v: ~is_blank(v))
    return F.when(any_filled, _digest(chosen)).otherwise(everything)


def content_hash_by(fields: Column, hash_fields: Column) -> Column:
    """``content_hash`` where every row brings its own ``hash_fields``; a missing list is empty."""
    stripped = F.transform(F.coalesce(hash_fields, F.array().cast("array<string>")), strip)
    chosen = F.transform(
        F.filter(stripped, lambda n: n != ""),
        lambda n: F.struct(n.alias("key"), F.coalesce(F.element_at(fields, n), F.lit("")).alias("value")),
    )
    any_filled = F.exists(chosen, lambda e: ~is_blank(e["value"]))
    return F.when(any_filled, _digest(chosen)).otherwise(_digest(F.map_entries(fields)))
