"""Resolving links against a page address."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagewatch.functions.text import bound, strip

# Links that start like this are kept as they are.
KEPT_PREFIXES = ["#", "javascript:", "mailto:", "tel:", "data:", "http://", "https://"]


def fold_path(path: Column) -> Column:
    """Drop empty and '.' parts and let '..' take back the part before it."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.array_append(kept, part)),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` on page ``base``. The host ends at the first '/', and the query counts as path."""
    return bound(strip(link), lambda value: bound(base, lambda page: _resolve(page, value)))


def _resolve(base: Column, value: Column) -> Column:
    scheme = F.substring_index(base, "://", 1)
    rest = F.substring(base, F.length(scheme) + 4, F.length(base))
    host = F.substring_index(rest, "/", 1)
    origin = F.concat(scheme, F.lit("://"), host)
    path = F.when(F.contains(rest, F.lit("/")), F.substring(rest, F.length(host) + 1, F.length(rest))).otherwise(F.lit("/"))
    folder = F.regexp_replace(path, r"(?s)/[^/]*$", "")
    kept = value == ""
    for prefix in KEPT_PREFIXES:
        kept = kept | F.startswith(value, F.lit(prefix))
    return (
        F.when(kept | ~F.contains(base, F.lit("://")), value)
        .when(F.startswith(value, F.lit("//")), F.concat(scheme, F.lit(":"), value))
        .when(F.startswith(value, F.lit("/")), F.concat(origin, value))
        .otherwise(F.concat(origin, fold_path(F.concat(folder, F.lit("/"), value))))
    )
