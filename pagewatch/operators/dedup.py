"""What is new: first occurrence within a batch, minus everything seen before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.functions.hashing import content_hash
from pagewatch.session import small
from pagewatch.spec import JobSpec


def hashed(items: DataFrame, hash_fields: Sequence[str] | None = None) -> DataFrame:
    return items.withColumn("hash", content_hash(F.col("fields"), hash_fields))


def first_of_each(items: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key. Every map task keeps one row per key before the shuffle, so copies stay cheap."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("_place", place).where("_place = 1").drop("_place")


def unseen(items: DataFrame, seen: DataFrame, keys: Sequence[str] = ("hash",)) -> DataFrame:
    """Items whose key is not in ``seen``; partitioned like the first-occurrence step, so items move once.

    The seen keys are made distinct on the map side: a key that was stored very often would otherwise fill one task,
    since the right side of an anti join cannot be split.
    """
    return items.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def seen_among(seen: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The part of ``seen`` that concerns ``items``. A small batch is broadcast, so a long history is only scanned.

    ``items`` are counted here, so they should be stored already.
    """
    wanted = items.select(*keys).distinct()
    found = small(wanted)
    return seen if found is wanted else seen.select(*keys).join(found, list(keys), "left_semi")


def new_items(items: DataFrame, seen: DataFrame, order: Sequence[str | Column], scope: str = "global") -> DataFrame:
    """First occurrences not seen before. The seen set is shared by all jobs unless ``scope='job'``."""
    keys = ["hash"] if scope == "global" else ["job_id", "hash"]
    return unseen(first_of_each(items, keys, order), seen, keys)


def as_records(new: DataFrame, ts_ns: Column, order: str = "item_ord", extra: Sequence[str] = ()) -> DataFrame:
    """Records of new items: ``records(job_id, fields, ts_ns, ord, hash, match_key)`` and any extra columns."""
    return new.select(
        "job_id", "fields", ts_ns.cast("bigint").alias("ts_ns"), F.col(order).cast("bigint").alias("ord"), "hash",
        F.col("matches").alias("match_key"), *extra,
    )


def seen_of(records: DataFrame, scope: str = "global") -> DataFrame:
    return records.select("hash") if scope == "global" else records.select("job_id", "hash")


def distinct_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Exact text identity; nothing is normalised."""
    return urls.dropDuplicates([column])


def hash_items(items: DataFrame, spec: JobSpec) -> DataFrame:
    return hashed(items, spec.hash_fields)
