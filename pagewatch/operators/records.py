"""Record queries: newest-N per job, keyset pages and what the results look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewatch.functions.text import nanos_to_utc
from pagewatch.operators.ordered import GROUP_ROWS, numbered
from pagewatch.session import small

# Page size when none or a bad one is asked for, and the largest page size.
PAGE_SIZE, MAX_PAGE_SIZE = 30, 1000
# Largest rank that Spark applies before the shuffle by default (spark.sql.optimizer.windowGroupLimitThreshold).
RANK_LIMIT = 1000


def page_size(asked: str | int | None) -> int:
    """What was asked for, up to the largest; anything but a plain number of ASCII digits is the default."""
    digits = str(asked) if isinstance(asked, (str, int)) and not isinstance(asked, bool) else ""
    plain = digits.removeprefix("+")
    return min(int(plain), MAX_PAGE_SIZE) if plain.isascii() and plain.isdigit() else PAGE_SIZE


def newest(records: DataFrame, limit: int | None) -> DataFrame:
    """Newest ``limit`` records of every job; all of them when there is no limit.

    A small rank filter reaches the map side, so a large job sends ``limit`` rows per task and not its whole history.
    Spark does that up to RANK_LIMIT; above it large jobs are ranked in pieces.
    """
    if limit is None:
        return records
    if limit > RANK_LIMIT:
        backwards = records.withColumns({"_ts": -F.col("ts_ns"), "_ord": -F.col("ord")})
        return numbered(backwards, ["job_id"], ["_ts", "_ord"], "_rank").where(F.col("_rank") <= limit).drop("_ts", "_ord", "_rank")
    window = Window.partitionBy("job_id").orderBy(F.desc("ts_ns"), F.desc("ord"))
    return records.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit).drop("_rank")


def keyset_page(
    records: DataFrame, job_id: str, limit: int, after: int | None = None, after_ord: int | None = None, after_hash: str | None = None
) -> DataFrame:
    """The next page of a job, newest first. The cursor is the last row's time, its ord among equal times, and its hash,
    of which a job has one record, among equal ords. Without the latter two, rows of the cursor's time are passed over."""
    rows = records.where(F.col("job_id") == job_id)
    if after is not None:
        older = F.col("ts_ns") < after
        if after_ord is not None:
            lower = F.col("ord") < after_ord
            if after_hash is not None:
                lower = lower | ((F.col("ord") == after_ord) & (F.col("hash") < after_hash))
            older = older | ((F.col("ts_ns") == after) & lower)
        rows = rows.where(older)
    return rows.orderBy(F.desc("ts_ns"), F.desc("ord"), F.desc("hash")).limit(limit)


def page_envelope(
    records: DataFrame, job_id: str, asked: str | int | None = None, after: int | None = None, after_ord: int | None = None,
    after_hash: str | None = None,
) -> DataFrame:
    """One row: the page as an array, its size limit, whether more may follow, and the next cursor in three parts. A page
    of no rows that was asked for has no cursor, so it never promises more."""
    limit = page_size(asked)
    page = keyset_page(records, job_id, limit, after, after_ord, after_hash)
    row = F.struct("ts_ns", "ord", "fields", "hash", "match_key", nanos_to_utc(F.col("ts_ns")).alias("date_time"))
    # A page holds at most MAX_PAGE_SIZE rows.
    gathered = page.agg(F.collect_list(row).alias("rows"), F.min(F.struct("ts_ns", "ord", "hash")).alias("last"))

    def newer(a: Column, b: Column) -> Column:
        tied = (a["ts_ns"] == b["ts_ns"]) & ((a["ord"] > b["ord"]) | ((a["ord"] == b["ord"]) & (a["hash"] > b["hash"])))
        return F.when((a["ts_ns"] > b["ts_ns"]) | tied, -1).otherwise(1)

    more = (F.size("rows") == limit) & F.lit(limit > 0)
    return gathered.select(
        F.array_sort("rows", newer).alias("records"), F.lit(limit).alias("limit"), more.alias("has_more"),
        *[F.when(more, F.col(f"last.{c}")).alias(name) for c, name in (("ts_ns", "next_after"), ("ord", "next_after_ord"), ("hash", "next_after_hash"))],
    )


def paged(records: DataFrame, asked: str | int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All records with the ``page`` of their job they stand on, from 1, newest first: what reading with cursors gives.

    Records are numbered in one pass, a large job in pieces, so the plan does not grow with the pages."""
    limit = page_size(asked)
    if not limit:  # a page of no rows never ends
        records, limit = records.limit(0), 1
    order = ["ts_ns", "ord", "hash"]
    totals = small(records.groupBy("job_id").agg(F.count(F.lit(1)).alias("_total")))
    placed = numbered(records, ["job_id"], order, "_place", group_rows).join(totals, "job_id")
    return placed.withColumn("page", F.floor((F.col("_total") - F.col("_place")) / limit) + 1).drop("_place", "_total")


def page_index(records: DataFrame, asked: str | int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The pages of every job: (job_id, page, rows, after, after_ord, after_hash), the cursor being that which
    ``keyset_page`` needs for the page; the first page has none. Any page can be read alone with it."""
    pages = paged(records, asked, group_rows).groupBy("job_id", "page").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct("ts_ns", "ord", "hash")).alias("_last")
    )
    # There are as many rows here as pages. A page and the next meet as one group; a join would read everything twice.
    here = F.struct("rows", F.lit(None).cast(dict(pages.dtypes)["_last"]).alias("last"))
    after = F.struct(F.lit(None).cast("bigint").alias("rows"), F.col("_last").alias("last"))
    both = pages.select("job_id", F.inline(F.array(
        F.struct(F.col("page"), here.alias("part")), F.struct((F.col("page") + 1).alias("page"), after.alias("part"))
    )))
    met = both.groupBy("job_id", "page").agg(F.max("part.rows").alias("rows"), F.max("part.last").alias("_last"))
    return met.where(F.col("rows").isNotNull()).select(
        "job_id", "page", "rows", F.col("_last.ts_ns").alias("after"), F.col("_last.ord").alias("after_ord"), F.col("_last.hash").alias("after_hash")
    )


def merged(records: DataFrame, limit: int | None) -> DataFrame:
    """The newest records of all jobs in one list, newest first."""
    return newest(records, limit).orderBy(F.desc("ts_ns"), F.desc("ord"))


def field_keys(records: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Names used in any record's fields with the first place they occur at."""
    place = F.struct("ts_ns", "ord", "_at")
    keys = records.select("ts_ns", "ord", F.posexplode(F.map_keys("fields")).alias("_at", "key"))
    return keys.where(~F.col("key").isin(*hidden) if hidden else F.lit(True)).groupBy("key").agg(F.min(place).alias("first_at"))


def job_summary(specs: DataFrame, records: DataFrame) -> DataFrame:
    """Every job with its number of stored records."""
    counts = records.groupBy("job_id").agg(F.count(F.lit(1)).alias("records"))
    return specs.join(counts, "job_id", "left").select(
        "job_id", "name", "enabled", F.coalesce("records", F.lit(0)).cast("bigint").alias("records")
    )
