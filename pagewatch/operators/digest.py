"""Notification texts and webhook payloads for the new items of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.functions.text import is_blank, label_of, render, strip
from pagewatch.operators.ordered import GROUP_ROWS, numbered
from pagewatch.spec import Notification

# Items shown in a digest, fields shown per item, and the line between items.
ITEMS_SHOWN, FIELDS_SHOWN, DIVIDER = 3, 5, "\n---\n"
# Items in one webhook payload; a run with more is sent as consecutive parts.
PART_ITEMS = 1000


def first_items(items: DataFrame, keys: Sequence[str], order: Sequence[str], count: int = ITEMS_SHOWN) -> DataFrame:
    """First ``count`` items per key, ranked on the map side before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= count)


def distinct_matches(items: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct keywords per key in the order they first occur, with their number and both joined forms.

    The keywords are made distinct first, so what is gathered per key is no longer than the job's keyword list.
    """
    place = F.struct(*order, "_at")
    # The outer form keeps Spark from filtering on size(matches) first, which would look for the keywords twice.
    words = items.select(*keys, *order, F.posexplode_outer("matches").alias("_at", "keyword")).where("keyword IS NOT NULL")
    first = words.groupBy(*keys, "keyword").agg(F.min(place).alias("place"))
    gathered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("_found"))
    found = F.transform("_found", lambda f: f["keyword"])
    return gathered.select(
        *keys, found.alias("all_matches"), F.size("_found").alias("match_count"),
        F.array_join(found, ", ").alias("matches_text"), F.array_join(found, "\n").alias("matches_lines"),
    )


def run_summary(items: DataFrame, keys: Sequence[str], order: Sequence[str], shown: Sequence[Column | str]) -> DataFrame:
    """Per key: number of items, their distinct matches and the first few items; no key is ever gathered whole."""
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("item_count"))
    top = first_items(items, keys, order).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", *shown)), lambda a, b: a["_rank"] - b["_rank"]).alias("shown")
    )
    matches = distinct_matches(items, keys, order)
    joined = counts.join(top, list(keys)).join(matches, list(keys), "left")
    return joined.withColumns({
        "match_count": F.coalesce("match_count", F.lit(0)),
        "matches_text": F.coalesce("matches_text", F.lit("")),
        "matches_lines": F.coalesce("matches_lines", F.lit("")),
    })


def default_title(name: Column, count: Column) -> Column:
    return F.when(count == 1, F.concat(F.lit("New match from "), name)).otherwise(
        F.concat(count.cast("string"), F.lit(" new matches from "), name)
    )


def item_lines(fields: Column, matches: Column, field_order: Sequence[str]) -> Column:
    """``Label: value`` for the first non-blank declared fields, then the keywords."""
    names = list(dict.fromkeys(field_order))
    lines = [
        F.when(~is_blank(value), F.concat(F.lit(f"{label_of(name)}: "), value))
        for name in names
        for value in [F.element_at(fields, F.lit(name))]
    ]
    shown = F.slice(F.array_compact(F.array(*lines)), 1, FIELDS_SHOWN)
    keywords = F.when(F.size(matches) > 0, F.array(F.concat(F.lit("Keywords: "), F.array_join(matches, ", ")))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(shown, keywords), "\n")


def body_text(parts: Column, count: Column) -> Column:
    more = F.concat(F.lit("+ "), (count - ITEMS_SHOWN).cast("string"), F.lit(" more"))
    listed = F.when(count > ITEMS_SHOWN, F.array_append(parts, more)).otherwise(parts)
    return F.array_join(listed, DIVIDER)


def digests(
    items: DataFrame,
    order: Sequence[str],
    field_order: Sequence[str],
    notification: Notification | None = None,
    url: Column | None = None,
    timestamp: Column | None = None,
    keys: Sequence[str] = ("job_id", "job_name"),
) -> DataFrame:
    """(job_id, job_name, item_count, title, body) per job with new items; none when notifications are off."""
    notification = notification or Notification()
    runs = run_summary(items, keys, order, ["fields", "matches"])
    count, name = F.col("item_count"), F.col("job_name")
    stamp = F.lit("") if timestamp is None else timestamp.cast("string")
    tags = {
        "job_name": name, "url": F.lit("") if url is None else url, "item_count": count, "timestamp": stamp, "time": stamp,
        "match_count": F.col("match_count"), "matches": F.col("matches_text"), "matches_multiline": F.col("matches_lines"),
    }
    plain = default_title(name, count)
    title = plain
    if notification.title is not None:
        rendered = strip(render(notification.title, tags))
        title = F.when(rendered == "", plain).otherwise(rendered)
    if notification.body is None:
        parts = F.transform("shown", lambda s: item_lines(s["fields"], s["matches"], field_order))
    else:
        parts = F.transform("shown", lambda s: render(notification.body, tags, s["fields"]))
    texts = runs.select(*keys, "item_count", title.alias("title"), body_text(parts, count).alias("body"))
    return texts if notification.enabled else texts.limit(0)


def json_text(value: Column) -> Column:
    """A string as a JSON string, quotes included."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def item_json(fields: Column, matches: Column) -> Column:
    """One item as a JSON object: its fields with sorted names, and ``keywords`` when there are any."""
    words = F.concat(F.lit("["), F.array_join(F.transform(matches, json_text), ","), F.lit("]"))
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), json_text(e["value"]).alias("json")))
    # A non-empty keyword list takes the place of a field of that name.
    replaced = F.array_append(
        F.filter(entries, lambda e: e["key"] != "keywords"), F.struct(F.lit("keywords").alias("key"), words.alias("json"))
    )
    chosen = F.array_sort(F.when(F.size(matches) > 0, replaced).otherwise(entries))
    pairs = F.transform(chosen, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def webhook_payloads(
    items: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ("job_id", "job_name"),
    part_items: int = PART_ITEMS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(job_id, job_name, part, parts, item_count, payload): every new item is in exactly one part, in order.

    A run of up to ``part_items`` items is one payload. A larger run is cut into parts, so that no row grows without
    bound; ``item_count`` in the payload is the count of the whole run, and a payload that is a part carries its number
    and that of all parts.
    """
    place = numbered(items, keys, order, "_place", group_rows)
    lines = place.select(
        *keys, "_place", (F.floor((F.col("_place") - 1) / part_items) + 1).cast("bigint").alias("part"),
        item_json(F.col("fields"), F.col("matches")).alias("json"),
    )
    parts = lines.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_place", "json"))).alias("lines"))
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("item_count"))
    body = F.array_join(F.transform("lines", lambda line: line["json"]), ",")
    payload = F.concat(
        F.lit('{"item_count":'), F.col("item_count").cast("string"), F.lit(',"items":['), body,
        F.lit('],"job_name":'), json_text(F.col("job_name")),
        # Only a run in several parts says so, so that a receiver can tell the items it got from those of the run.
        F.when(F.col("item_count") > part_items, F.concat(F.lit(',"part":'), F.col("part").cast("string"), F.lit(',"parts":'), F.ceil(F.col("item_count") / part_items).cast("string"))).otherwise(""),
        F.lit("}"),
    )
    return parts.join(counts, list(keys)).select(
        *keys, "part", F.ceil(F.col("item_count") / part_items).cast("bigint").alias("parts"), "item_count", payload.alias("payload")
    )


def threshold(runs: DataFrame, least: int, count: str = "item_count") -> DataFrame:
    """Runs with fewer new items than ``least`` stay silent."""
    return runs.where(F.col(count) >= least)
