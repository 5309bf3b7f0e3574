"""Queries that run the monitor cycle, its hooks and the streaming forms over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewatch.functions import text
from pagewatch.operators import filters, signals
from pagewatch.operators.extract import extract_items
from pagewatch.operators.records import paged
from pagewatch.plans import sql
from pagewatch.plans.catalog_pages import HAY, JOBS_SQL, NAV, host_jobs
from pagewatch.plans.catalog_signals import BREAKER_SQL, HEARTBEATS_SQL, PRICE_ALERTS_SQL, PRICE_ORDER, RULES, breaker_input, priced_lines
from pagewatch.plans.cycle import Cycle, Hooks
from pagewatch.plans.many_jobs import ManyJobs
from pagewatch.plans.registry import query
from pagewatch.session import scratch
from pagewatch.sources.pages import scan, scan_pages
from pagewatch.sources.sinks import RecordStore
from pagewatch.streaming import keyed, monitor
from pagewatch.spec import Notification

TEXT_ONLY = replace(NAV, hash_fields=["text"])

KEPT = f"""
    kept AS (SELECT page_id, item_ord, url, {sql.clean('txt')} AS text, {HAY} AS hay FROM ({sql.LIST_ITEMS})
             WHERE contains({HAY}, 'the') OR contains({HAY}, 'und') OR contains({HAY}, 'les')),
    first AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY text ORDER BY page_id, item_ord) = 1)
"""


def stored(records: DataFrame) -> DataFrame:
    return records.select("page_id", F.col("ord").cast("int").alias("item_ord"), F.element_at("fields", F.lit("text")).alias("text"))


@query("t01_continuous_monitor", f"WITH {KEPT} SELECT page_id, item_ord, text FROM first")
def continuous_monitor(spark: SparkSession, folder: str) -> DataFrame:
    """The cycle over a stream of page files, run once over what is there."""
    base = scratch(spark)
    cycle = Cycle(TEXT_ONLY, RecordStore(spark, base))
    schema = scan(spark, folder, "pages").schema
    monitor.monitor(monitor.stream_pages(spark, f"{folder}/pages*.parquet", schema), cycle, f"{base}/progress").awaitTermination()
    return stored(cycle.store.records())


@query("t02_streaming_dedup", f"WITH {KEPT} SELECT DISTINCT text FROM kept")
def streaming_dedup(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch(spark)
    pages = monitor.stream_pages(spark, f"{folder}/pages*.parquet", scan(spark, folder, "pages").schema)
    items = monitor.stream_new_items(pages, TEXT_ONLY).select(F.element_at("fields", F.lit("text")).alias("text"))
    writer = items.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    writer.start(f"{base}/items").awaitTermination()
    return spark.read.schema("text string").parquet(f"{base}/items")


def in_time_slices(rows: DataFrame, slice_no, base: str, slices: int, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a stream slice by slice, in order: the files of a slice, as many as the tasks that write them, are all there is new
    when the stream goes on from its progress, so they are one micro-batch."""
    for number in range(slices):
        rows.where(slice_no == number).write.mode("append").parquet(f"{base}/slices")
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{base}/slices")).awaitTermination()


@query("t03_breaker_stream", BREAKER_SQL)
def breaker_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The circuit breaker over three micro-batches gives what one batch gives."""
    base = scratch(spark)
    rows = breaker_input(spark, folder)
    ends = rows.agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
    slice_no = F.least(F.floor((F.col("time") - ends["low"]) * 3 / (ends["high"] - ends["low"] + 1)), F.lit(2))
    state = keyed.KeyedTables(base, "job_id bigint, fail_count double, stop_time double")
    step = keyed.breaker_step("job_id", ["time", "attempt_id"], RULES)
    in_time_slices(rows, slice_no, base, 3, lambda stream: keyed.keyed_stream(stream, state, step, f"{base}/progress"))
    outcomes = state.outcomes(spark)
    return outcomes.select("attempt_id", "action", "alerts", F.col("fail_count").cast("bigint").alias("fail_count"))


@query("t04_minimum_stream", PRICE_ALERTS_SQL)
def minimum_stream(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch(spark)
    rows = priced_lines(spark, folder)
    at = text.wall_seconds(F.col("l_shipdate"))
    bounds = rows.agg(F.percentile_approx(at, [0.33, 0.66])).first()[0]
    slice_no = F.when(at <= bounds[0], 0).when(at <= bounds[1], 1).otherwise(2)
    state = keyed.KeyedTables(base, "l_partkey bigint, min_price double")
    step = keyed.minima_step("l_partkey", PRICE_ORDER, F.col("price"), F.col("title"))
    in_time_slices(rows, slice_no, base, 3, lambda stream: keyed.keyed_stream(stream, state, step, f"{base}/progress"))
    return state.outcomes(spark).select("l_partkey", "l_orderkey", "l_linenumber", "price", "prior_min", "alert")


@query("t05_heartbeat_stream", HEARTBEATS_SQL)
def heartbeat_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One beat a day for every user, whichever batch its ticks come in."""
    base = scratch(spark)
    rows = scan(spark, folder, "events").select("event_id", "user_id", text.wall_seconds(F.col("ts")).alias("time"))
    middle = rows.agg(F.avg("time")).first()[0]
    slice_no = F.when(F.col("time") <= middle, 0).otherwise(1)
    state = keyed.KeyedTables(base, "user_id bigint, last_beat double")
    step = keyed.heartbeat_step("user_id", ["time", "event_id"], "time", signals.DAY)
    in_time_slices(rows, slice_no, base, 2, lambda stream: keyed.keyed_stream(stream, state, step, f"{base}/progress"))
    return state.outcomes(spark).where("beat").select("event_id", "user_id")


@query("t01_many_jobs_batches", f"""
    WITH {JOBS_SQL}, batches AS (SELECT *, page_id % 2 AS batch_id FROM kept),
    new AS (SELECT * FROM batches QUALIFY row_number() OVER (PARTITION BY text ORDER BY batch_id, page_id, item_ord, job_id) = 1),
    per_job AS (SELECT job_id, page_id % 2 AS batch_id, count(*) AS pages FROM routed GROUP BY ALL)
    SELECT j.job_id, b.batch_id, coalesce(p.pages, 0) AS pages, CAST(0 AS BIGINT) AS failed,
           (SELECT count(*) FROM found f WHERE f.job_id = j.job_id AND f.page_id % 2 = b.batch_id) AS selector_matches,
           (SELECT count(*) FROM batches k WHERE k.job_id = j.job_id AND k.batch_id = b.batch_id) AS kept,
           (SELECT count(*) FROM new n WHERE n.job_id = j.job_id AND n.batch_id = b.batch_id) AS new
    FROM (SELECT DISTINCT job_id FROM routed) j, (VALUES (0), (1)) AS b(batch_id)
    LEFT JOIN per_job p ON p.job_id = j.job_id AND p.batch_id = b.batch_id
""")
def many_jobs_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All jobs of a specification table over two batches of pages, with one dedup over all of them."""
    many = ManyJobs(host_jobs(spark, folder), RecordStore(spark, scratch(spark)))
    pages = scan_pages(spark, folder)
    runs = [many.run(pages.where(F.pmod("page_id", F.lit(2)) == n), n, F.lit(n)).withColumn("batch_id", F.lit(n)) for n in (0, 1)]
    return runs[0].unionByName(runs[1]).drop("diagnosis")


@query("d02_two_runs_nothing_new", f"WITH {KEPT} SELECT 0 AS run, count(*) AS new FROM first UNION ALL SELECT 1, 0")
def two_runs_nothing_new(spark: SparkSession, folder: str) -> DataFrame:
    """D2 and S8 over the cycle: the same pages again bring nothing new."""
    cycle = Cycle(TEXT_ONLY, RecordStore(spark, scratch(spark)))
    pages = scan_pages(spark, folder)
    runs = [cycle.run(pages, number).select(F.lit(number).alias("run"), F.col("new").cast("bigint").alias("new")) for number in (0, 1)]
    return runs[0].unionByName(runs[1])


@query("h01_h02_request_stages", f"""
    WITH {KEPT} SELECT page_id, item_ord, text FROM kept WHERE starts_with(url, 'https:') QUALIFY row_number() OVER (PARTITION BY text ORDER BY page_id, item_ord) = 1
""")
def request_stages(spark: SparkSession, folder: str) -> DataFrame:
    """H1 and H2: requests are rewritten and skipped, and pages are supplied by the user's own table."""
    bodies = scan_pages(spark, folder).select("page_id", "html")
    hooks = Hooks(
        before_fetch=lambda requests: requests.where(F.startswith("url", F.lit("https:"))),
        override_fetch=lambda requests: requests.join(bodies, "page_id"),
    )
    cycle = Cycle(TEXT_ONLY, RecordStore(spark, scratch(spark)), hooks)
    cycle.run(scan(spark, folder, "pages").select("page_id", "url"), 1)
    return stored(cycle.store.records())


@query("h03_recovered_fetch", f"""
    WITH {KEPT} SELECT page_id, item_ord, text FROM kept WHERE NOT ends_with(url, '/') QUALIFY row_number() OVER (PARTITION BY text ORDER BY page_id, item_ord) = 1
""")
def recovered_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """H3: failed fetches of '#top' addresses are recovered from another table, those of '/' addresses stay failed."""
    pages = scan_pages(spark, folder)
    lost = F.endswith("url", F.lit("#top")) | F.endswith("url", F.lit("/"))
    log = pages.select(
        "page_id", "url", F.when(~lost, F.col("html")).alias("html"), F.when(lost, "Request timed out").alias("error"),
    )
    backup = pages.where(F.endswith("url", F.lit("#top"))).select("page_id", F.col("html").alias("saved"))

    def recover(results: DataFrame) -> DataFrame:
        joined = results.join(backup, "page_id", "left")
        return joined.withColumns({
            "error": F.when(F.col("saved").isNull(), F.col("error")), "html": F.coalesce("html", "saved"),
        }).drop("saved")

    cycle = Cycle(TEXT_ONLY, RecordStore(spark, scratch(spark)), Hooks(after_fetch=recover))
    cycle.run(log, 1)
    return stored(cycle.store.records())


@query("h04_custom_extraction", """
    SELECT title, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages) GROUP BY title
""")
def custom_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """H4: the user's own extraction, one item per page."""
    def titles(pages: DataFrame) -> DataFrame:
        title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
        return pages.select("page_id", F.lit(0).alias("item_ord"), F.create_map(F.lit("text"), title).alias("fields"))

    cycle = Cycle(replace(TEXT_ONLY, keywords=None), RecordStore(spark, scratch(spark)), Hooks(override_extract=titles))
    cycle.run(scan_pages(spark, folder), 1)
    return stored(cycle.store.records()).select(F.col("text").alias("title"), "page_id")


@query("h05_h06_h07_item_stages", f"""
    WITH found AS (SELECT page_id, item_ord, {sql.clean('txt')} AS plain FROM ({sql.LIST_ITEMS})),
    hit AS (SELECT * FROM found WHERE len(list_filter(['the', 'und', 'les'], lambda k: contains(lower(plain), k))) > 0 AND length(plain) < 12),
    items AS (SELECT page_id, item_ord, upper(replace(plain, 'ß', 'SS')) AS text FROM hit),
    kept AS (SELECT * FROM items WHERE length(text) > 4 AND text NOT LIKE 'A%')
    SELECT page_id, item_ord, text, array_to_string(list_filter(['the', 'und', 'les'], lambda k: contains(lower(text), k)), ',') AS matches FROM kept
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY page_id, item_ord) = 1
""")
def item_stages(spark: SparkSession, folder: str) -> DataFrame:
    """H5, H6 and H7: items with a keyword are thinned, rewritten one by one with matches read again, and thinned before
    storing."""
    upper = filters.with_field(F.col("fields"), "text", F.upper(filters.field("text")))
    hooks = Hooks(
        after_extract=lambda items: items.where(F.length(filters.field("text")) < 12),
        filter_item=lambda items: items.where(F.length(filters.field("text")) > 4).withColumn("fields", upper),
        before_store=lambda items: items.where(~F.startswith(filters.field("text"), F.lit("A"))),
    )
    cycle = Cycle(replace(TEXT_ONLY, search_fields=["text"]), RecordStore(spark, scratch(spark)), hooks)
    cycle.run(scan_pages(spark, folder), 1)
    rows = cycle.store.records()
    return rows.select(
        "page_id", F.col("ord").cast("int").alias("item_ord"), F.element_at("fields", F.lit("text")).alias("text"), F.array_join("match_key", ",").alias("matches")
    )


@query("h08_h09_outbox_stages", f"""
    WITH {KEPT}, told AS (SELECT count(*) AS n FROM first WHERE length(text) > 5)
    SELECT 'notification' AS outbox, n || ' new matches from Nav Links' AS title, n AS items FROM told
    UNION ALL SELECT 'webhook', 'part ' || (place // 1000 + 1), count(*) FROM (SELECT row_number() OVER (ORDER BY page_id, item_ord) - 1 AS place FROM first) GROUP BY place // 1000
""")
def outbox_stages(spark: SparkSession, folder: str) -> DataFrame:
    """H8 and H9: the digest gets a reduced list, the webhook payload another shape; both as outbox rows."""
    hooks = Hooks(
        before_notify=lambda items: items.where(F.length(F.element_at("fields", F.lit("text"))) > 5),
        before_webhook=lambda rows: rows.withColumn("payload", F.regexp_replace("payload", '"items":', '"rows":')),
    )
    spec = replace(TEXT_ONLY, notification=Notification(), webhook={"url": "https://hook.example.com/"})
    base = scratch(spark)
    Cycle(spec, RecordStore(spark, base), hooks).run(scan_pages(spark, folder), 1)
    told = spark.read.schema("item_count bigint, title string").json(f"{base}/notifications/batch_id=1")
    sent = spark.read.schema("part bigint, payload string").json(f"{base}/webhooks/batch_id=1")
    rows = F.size(F.from_json("payload", "rows array<struct<text:string>>")["rows"]).cast("bigint")
    return told.select(F.lit("notification").alias("outbox"), "title", F.col("item_count").alias("items")).unionByName(
        sent.select(F.lit("webhook").alias("outbox"), F.concat(F.lit("part "), F.col("part").cast("string")).alias("title"), rows.alias("items"))
    )


@query("l02_page_to_the_end", f"WITH {KEPT} SELECT page_id, item_ord, text FROM first")
def page_to_the_end(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a run, which share one time, page by page; the pages are numbered in one pass."""
    cycle = Cycle(TEXT_ONLY, RecordStore(spark, scratch(spark)))
    cycle.run(scan_pages(spark, folder), 1)
    return stored(paged(cycle.store.records(), 100))


STAGE_HOOKS = "before_fetch override_fetch after_fetch override_extract after_extract filter_item before_store before_notify before_webhook".split()


@query("h_skip_stages", f"""
    WITH {KEPT}, n AS (SELECT (SELECT count(*) FROM first) AS new, (SELECT count(*) FROM pages) AS pages),
    hooks AS (SELECT unnest({STAGE_HOOKS}) AS hook)
    SELECT hook, CASE WHEN hook IN ('before_fetch', 'after_fetch') THEN 0 ELSE pages END AS processed,
           CASE WHEN hook = 'override_fetch' THEN pages ELSE 0 END AS failed,
           CASE WHEN hook IN ('before_notify', 'before_webhook') THEN new ELSE 0 END AS new,
           CASE WHEN hook = 'before_webhook' THEN new ELSE 0 END AS told, hook = 'before_notify' AS sent
    FROM hooks, n
""")
def skip_stages(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of a run when one of its hooks answers with nothing."""
    spec, found = replace(TEXT_ONLY, notification=Notification(), webhook={"url": "https://hook.example.com/"}), []
    for number, hook in enumerate(STAGE_HOOKS):
        cycle = Cycle(spec, RecordStore(spark, f"{scratch(spark)}/{hook}"), Hooks(**{hook: lambda rows: None}))
        counts = cycle.run(scan_pages(spark, folder), number)
        sent = F.exists("stages", lambda s: s["stage"] == "webhook")
        notified = F.when(F.exists("stages", lambda s: s["stage"] == "notify"), F.col("notified")).otherwise(0)
        found.append(counts.select(F.lit(hook).alias("hook"), "processed", "failed", F.col("new").cast("bigint").alias("new"), notified.cast("bigint").alias("told"), sent.alias("sent")))
    return reduce(DataFrame.unionByName, found)


@query("s03_nothing_vanishes", """
    SELECT count(*) AS processed, count(*) FILTER (strlen(html) > 4000) AS failed, count(*) FILTER (strlen(html) > 4000) AS rejected FROM pages
""")
def nothing_vanishes(spark: SparkSession, folder: str) -> DataFrame:
    """Every page of a run is either read or a row of the rejected outbox. Here those over 4,000 bytes fail to be fetched."""
    base = scratch(spark)
    error = F.when(F.octet_length("html") > 4000, "too much to fetch")
    cycle = Cycle(TEXT_ONLY, RecordStore(spark, base), Hooks(override_fetch=lambda pages: pages.withColumn("error", error)))
    counts = cycle.run(scan_pages(spark, folder), 1)
    rows = spark.read.schema("page_id bigint, error string").json(f"{base}/rejected/batch_id=1").withColumn("job_id", F.lit(TEXT_ONLY.job_id))
    rejected = rows.groupBy("job_id").agg(F.count("error").alias("rejected"))
    return counts.join(rejected, "job_id").select("processed", "failed", "rejected")


@query("h10_run_callbacks", f"WITH {KEPT} SELECT 'on_success' AS called, (SELECT count(*) FROM first) AS new UNION ALL SELECT 'on_finally', 0")
def run_callbacks(spark: SparkSession, folder: str) -> DataFrame:
    """H10: the callbacks of a run get its counts."""
    called: list[DataFrame] = []
    nothing = spark.range(1).select(F.lit("on_finally").alias("called"), F.lit(0).cast("bigint").alias("new"))
    hooks = Hooks(
        on_success=lambda counts: called.append(counts.select(F.lit("on_success").alias("called"), F.col("new").cast("bigint").alias("new"))),
        on_finally=lambda: called.append(nothing),
    )
    Cycle(TEXT_ONLY, RecordStore(spark, scratch(spark)), hooks).run(scan_pages(spark, folder), 1)
    return called[0].unionByName(called[1])


@query("h11_start_and_finish", f"""
    WITH {KEPT}, mine AS (SELECT DISTINCT text FROM kept WHERE NOT contains(url, '?'))
    SELECT 'nav_links' AS job_id, (SELECT count(*) FROM ({sql.LIST_ITEMS}) WHERE NOT contains(url, '?')) AS selector_matches,
           (SELECT count(*) FROM mine) AS new
""")
def start_and_finish(spark: SparkSession, folder: str) -> DataFrame:
    """H11: the address batch is computed at the start, and the counts come back at the end of the stream's batch."""
    base = scratch(spark)
    finished: list[DataFrame] = []
    chosen = scan(spark, folder, "pages").where(~F.contains("url", F.lit("?"))).select("url")
    cycle = Cycle(TEXT_ONLY, RecordStore(spark, base), Hooks(on_start=lambda session: chosen, on_finished=finished.append), batch_limit=None)
    cycle.hooks.before_fetch = cycle.batch_pages
    stream = monitor.stream_pages(spark, f"{folder}/pages*.parquet", scan(spark, folder, "pages").schema)
    monitor.monitor(stream, cycle, f"{base}/progress").awaitTermination()
    return finished[0].select("job_id", "selector_matches", F.col("new").cast("bigint").alias("new"))


@query("h12_item_identity", f"""
    WITH {KEPT}
    SELECT page_id, item_ord, array_to_string(list_filter(['the', 'und', 'les'], lambda k: contains(hay, k)), ',') AS matches FROM kept
    UNION ALL SELECT page_id, -1, '' FROM pages
""")
def item_identity(spark: SparkSession, folder: str) -> DataFrame:
    """H12: items that come back from a hook keep their matches by identity; new ones start without any."""
    pages = scan_pages(spark, folder)
    items = extract_items(pages, NAV)
    changed = items.select("page_id", "item_ord", filters.with_field(F.col("fields"), "text", F.lit("rewritten")).alias("fields"))
    added = pages.select("page_id", F.lit(-1).alias("item_ord"), F.create_map(F.lit("text"), F.lit("added")).alias("fields"))
    back = filters.reattached(changed.unionByName(added), items, ["page_id", "item_ord"])
    return back.select("page_id", "item_ord", F.array_join("matches", ",").alias("matches"))
