"""Queries over stored records and run results: paging, summaries, digests, payloads and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.functions.matching import keyword_matches
from pagewatch.operators import digest, records, signals
from pagewatch.operators.dedup import hashed, new_items
from pagewatch.operators.extract import extract_items, extract_pages, items_of
from pagewatch.operators.ordered import numbered
from pagewatch.plans import sql
from pagewatch.plans.catalog_pages import HAY, NAV
from pagewatch.plans.registry import query
from pagewatch.plans.samples import (
    ATTEMPTS_SQL, EPOCH, RECORDS_SQL, document_items, document_records, event_attempts, string_map,
)
from pagewatch.session import durable, scratch
from pagewatch.sources import files
from pagewatch.sources.pages import flatten_headers, scan, scan_pages
from pagewatch.sources.sinks import RecordStore, write_debug, write_outbox
from pagewatch.spec import JobSpec, Notification


@query("s04_record_scan", f"SELECT ts_ns, ord, lang FROM ({RECORDS_SQL}) WHERE job_id = 'src3'")
def record_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_records(spark, folder).where(F.col("job_id") == "src3").orderBy(F.desc("ts_ns"), F.desc("ord"))
    return rows.select("ts_ns", "ord", F.element_at("fields", F.lit("lang")).alias("lang"))


@query("w01_newest_per_job", f"""
    SELECT job_id, ts_ns, ord FROM ({RECORDS_SQL}) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts_ns DESC, ord DESC) <= 7
""")
def newest_per_job(spark: SparkSession, folder: str) -> DataFrame:
    return records.newest(document_records(spark, folder).select("job_id", "ts_ns", "ord"), 7)


@query("l01_keyset_page", f"""
    SELECT ts_ns, ord FROM ({RECORDS_SQL}) WHERE job_id = 'src5' AND ts_ns < {(EPOCH + 15) * 1_000_000_000} ORDER BY ts_ns DESC, ord DESC LIMIT 5
""")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    page = records.keyset_page(document_records(spark, folder), "src5", 5, after=(EPOCH + 15) * 1_000_000_000)
    return page.select("ts_ns", "ord")


@query("l02_page_envelope", f"""
    WITH page AS (SELECT * FROM ({RECORDS_SQL}) WHERE job_id = 'src5' ORDER BY ts_ns DESC, ord DESC LIMIT 30)
    SELECT string_agg(ord, ',' ORDER BY ts_ns DESC, ord DESC) AS ords,
           string_agg(DISTINCT strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%SZ'), ',' ORDER BY strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%SZ')) AS times,
           30 AS "limit", count(*) = 30 AS has_more, CASE WHEN count(*) = 30 THEN min(ts_ns) END AS next_after FROM page
""")
def page_envelope(spark: SparkSession, folder: str) -> DataFrame:
    page = records.page_envelope(document_records(spark, folder), "src5", "many")
    return page.select(
        F.array_join(F.transform("records", lambda r: r["ord"].cast("string")), ",").alias("ords"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("records", lambda r: r["date_time"]))), ",").alias("times"),
        "limit", "has_more", "next_after",
    )


@query("l03_merged_newest", f"""
    SELECT job_id, ts_ns, ord, row_number() OVER (ORDER BY ts_ns DESC, ord DESC) AS place FROM (
        SELECT job_id, ts_ns, ord FROM ({RECORDS_SQL}) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts_ns DESC, ord DESC) <= 3)
""")
def merged_newest(spark: SparkSession, folder: str) -> DataFrame:
    newest = records.merged(document_records(spark, folder).select("job_id", "ts_ns", "ord"), 3)
    backwards = newest.withColumns({"_ts": -F.col("ts_ns"), "_ord": -F.col("ord")})
    return numbered(backwards, [], ["_ts", "_ord"], "place").drop("_ts", "_ord")


@query("a06_schema_discovery", """
    SELECT 'text' AS key, min(doc_id) AS first_ord FROM documents UNION ALL SELECT 'lang', min(doc_id) FROM documents
    UNION ALL SELECT 'only_' || lang, min(doc_id) FROM documents GROUP BY lang
""")
def schema_discovery(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_records(spark, folder)
    lang = F.element_at("fields", F.lit("lang"))
    wider = rows.withColumn("fields", F.map_concat("fields", F.create_map(F.concat(F.lit("only_"), lang), F.lit("x"))))
    keys = records.field_keys(wider, hidden=("source",))
    return keys.select("key", F.col("first_at.ord").alias("first_ord"))


@query("a08_job_summary", f"""
    SELECT 'src' || r.i AS job_id, 'Src ' || r.i AS name, r.i % 3 <> 0 AS enabled, (SELECT count(*) FROM documents WHERE source = 'src' || r.i) AS records
    FROM (SELECT p_size AS i FROM part GROUP BY p_size) AS r
""")
def job_summary(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    specs = scan(spark, folder, "part").select("p_size").distinct().select(
        F.concat(F.lit("src"), size).alias("job_id"), F.concat(F.lit("Src "), size).alias("name"),
        (F.pmod("p_size", F.lit(3)) != 0).alias("enabled"),
    )
    return records.job_summary(specs, document_records(spark, folder))


@query("a01_run_stats", f"""
    SELECT job_id, count(*) AS processed, count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM ({ATTEMPTS_SQL}) GROUP BY job_id
""")
def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    return signals.cycle_stats(event_attempts(spark, folder), F.col("error").isNotNull(), ["job_id"])


TURN_MATCHES = "list_filter(['the', 'les', 'und', 'que', 'para'], lambda k: contains(" + sql.ascii_lower('role || \' \' || "text"') + ", k))"


def turn_items(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as items of one job per conversation."""
    spec_words = ["the", "les", "und", "que", "para"]
    fields = string_map(role=F.col("role"), text=F.col("text"), empty_field=F.lit(" "))
    turns = scan(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("job_id"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("job_name"),
        "turn", fields.alias("fields"),
    )
    return turns.withColumn("matches", keyword_matches(F.col("fields"), spec_words, ["role", "text"]))


@query("a02_distinct_matches", f"""
    WITH words AS (SELECT conv_id, turn, m, generate_subscripts(m, 1) AS place, unnest(m) AS word FROM (SELECT conv_id, turn, {TURN_MATCHES} AS m FROM conversations)),
    first AS (SELECT conv_id, word, min(turn * 100 + place) AS place FROM words GROUP BY conv_id, word)
    SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(count(*) AS INTEGER) AS match_count, string_agg(word, ', ' ORDER BY place) AS matches_text,
           string_agg(word, chr(10) ORDER BY place) AS matches_lines FROM first GROUP BY conv_id
""")
def distinct_matches(spark: SparkSession, folder: str) -> DataFrame:
    return digest.distinct_matches(turn_items(spark, folder), ["job_id"], ["turn"]).drop("all_matches")


@query("l04_first_items_overflow", """
    SELECT CAST(conv_id AS VARCHAR) AS job_id, string_agg(CASE WHEN turn_place <= 3 THEN role END, ',' ORDER BY turn) AS shown,
           CASE WHEN count(*) > 3 THEN '+ ' || (count(*) - 3) || ' more' ELSE '' END AS more
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_place FROM conversations) GROUP BY conv_id
""")
def first_items_overflow(spark: SparkSession, folder: str) -> DataFrame:
    runs = digest.run_summary(turn_items(spark, folder), ["job_id"], ["turn"], ["fields"])
    roles = F.array_join(F.transform("shown", lambda s: F.element_at(s["fields"], F.lit("role"))), ",")
    left = F.col("item_count") - digest.ITEMS_SHOWN
    more = F.when(left > 0, F.concat(F.lit("+ "), left.cast("string"), F.lit(" more"))).otherwise("")
    return runs.select("job_id", roles.alias("shown"), more.alias("more"))


DEFAULT_ITEM = (
    "'Role: ' || role || CASE WHEN trim(\"text\") <> '' THEN chr(10) || 'Text: ' || \"text\" ELSE '' END"
    " || CASE WHEN len(m) > 0 THEN chr(10) || 'Keywords: ' || array_to_string(m, ', ') ELSE '' END"
)
RUNS = f"""
    turns AS (SELECT *, {TURN_MATCHES} AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
"""


DIGEST_SQL = f"""
    WITH {RUNS}
    SELECT CAST(conv_id AS VARCHAR) AS job_id, 'Talk ' || conv_id AS job_name, max(n) AS item_count,
           CASE WHEN max(n) = 1 THEN 'New match from Talk ' || conv_id ELSE max(n) || ' new matches from Talk ' || conv_id END AS title,
           string_agg({DEFAULT_ITEM}, chr(10) || '---' || chr(10) ORDER BY turn) FILTER (WHERE place <= 3)
             || CASE WHEN max(n) > 3 THEN chr(10) || '---' || chr(10) || '+ ' || (max(n) - 3) || ' more' ELSE '' END AS body
    FROM turns GROUP BY conv_id
"""


@query("n01_default_digest", DIGEST_SQL)
def default_digest(spark: SparkSession, folder: str) -> DataFrame:
    return digest.digests(turn_items(spark, folder), ["turn"], ["role", "text", "role", "empty_field", "absent"])


@query("n02_template_digest", f"""
    WITH {RUNS},
    words AS (SELECT conv_id, turn, generate_subscripts(m, 1) AS at_word, unnest(m) AS word FROM turns),
    first AS (SELECT conv_id, word, min(turn * 100 + at_word) AS place FROM words GROUP BY conv_id, word),
    found AS (SELECT conv_id, count(*) AS k, string_agg(word, ', ' ORDER BY place) AS words FROM first GROUP BY conv_id)
    SELECT CAST(t.conv_id AS VARCHAR) AS job_id, 'Talk ' || t.conv_id AS job_name, max(n) AS item_count,
           max(n) || ' of Talk ' || t.conv_id || ': ' || coalesce(max(words), '') || ' (' || coalesce(max(k), 0) || ') {{no tag}}' AS title,
           string_agg('[' || role || '] ' || "text" || ' <>', chr(10) || '---' || chr(10) ORDER BY turn) FILTER (WHERE place <= 3)
             || CASE WHEN max(n) > 3 THEN chr(10) || '---' || chr(10) || '+ ' || (max(n) - 3) || ' more' ELSE '' END AS body
    FROM turns t LEFT JOIN found f ON f.conv_id = t.conv_id GROUP BY t.conv_id
""")
def template_digest(spark: SparkSession, folder: str) -> DataFrame:
    told = Notification(title="  {item_count} of {job_name}: {matches} ({match_count}) {no tag} ", body="[{role}] {text} <{unknown}>")
    return digest.digests(turn_items(spark, folder), ["turn"], ["role"], told)


@query("n03_webhook_payload", f"""
    WITH {RUNS},
    lines AS (SELECT conv_id, turn, n, '{{"empty_field":" "' || CASE WHEN len(m) > 0 THEN ',"keywords":' || CAST(to_json(m) AS VARCHAR) ELSE '' END
              || ',"role":' || CAST(to_json(role) AS VARCHAR) || ',"text":' || CAST(to_json("text") AS VARCHAR) || '}}' AS line FROM turns)
    SELECT CAST(conv_id AS VARCHAR) AS job_id, 'Talk ' || conv_id AS job_name, CAST(1 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, max(n) AS item_count,
           '{{"item_count":' || max(n) || ',"items":[' || string_agg(line, ',' ORDER BY turn) || '],"job_name":"Talk ' || conv_id || '"}}' AS payload
    FROM lines GROUP BY conv_id
""")
def webhook_payload(spark: SparkSession, folder: str) -> DataFrame:
    return digest.webhook_payloads(turn_items(spark, folder), ["turn"])


@query("n03_webhook_parts", f"""
    WITH {RUNS}
    SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST((place - 1) // 2 + 1 AS BIGINT) AS part, CAST((max(n) + 1) // 2 AS BIGINT) AS parts, max(n) AS item_count,
           string_agg(role, ',' ORDER BY turn) AS roles
    FROM turns GROUP BY conv_id, (place - 1) // 2 + 1
""")
def webhook_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = digest.webhook_payloads(turn_items(spark, folder), ["turn"], part_items=2)
    roles = F.array_join(F.regexp_extract_all("payload", F.lit('"role":"([^"]*)"'), F.lit(1)), ",")
    return parts.select("job_id", "part", "parts", "item_count", roles.alias("roles"))


HOST = "regexp_extract(url, '://([^/]*)', 1)"


def funnel_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages with their list items counted; items with keywords; and those not already stored from the http pages."""
    pages = scan_pages(spark, folder)
    rows = durable(extract_pages(pages, NAV).withColumn("status", F.when(F.contains("url", F.lit("?")), 404).otherwise(200)))
    kept = hashed(items_of(rows, NAV), ["text"])
    https = F.startswith("url", F.lit("https:"))
    new = new_items(kept.where(https), kept.where(~https), ["page_id", "item_ord"])
    return rows, kept, new


def page_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Funnel per page: list items selected, with keywords, and on the first half of the corpus already stored."""
    rows, kept, new = funnel_parts(spark, folder)
    told = digest.first_items(new, ["page_id"], ["item_ord"], 1)
    return signals.funnel(rows, kept, new, told, ["page_id"])


FUNNEL = f"""
    items AS (
        SELECT page_id, item_ord, url, {sql.clean('txt')} AS txt, {HAY} AS hay FROM ({sql.LIST_ITEMS})),
    kept AS (SELECT * FROM items WHERE contains(hay, 'the') OR contains(hay, 'und') OR contains(hay, 'les')),
    new AS (
        SELECT * FROM kept WHERE starts_with(url, 'https:') AND txt NOT IN (SELECT txt FROM kept WHERE NOT starts_with(url, 'https:'))
        QUALIFY row_number() OVER (PARTITION BY txt ORDER BY page_id, item_ord) = 1),
    funnel AS (
        SELECT p.page_id, (SELECT count(*) FROM items i WHERE i.page_id = p.page_id) AS selector_matches,
               CASE WHEN contains(url, '?') THEN 404 ELSE 200 END AS status,
               (SELECT count(*) FROM kept k WHERE k.page_id = p.page_id) AS kept,
               (SELECT count(*) FROM new n WHERE n.page_id = p.page_id) AS new,
               least(1, (SELECT count(*) FROM new n WHERE n.page_id = p.page_id)) AS notified
        FROM pages p)
"""


@query("a03_match_funnel", f"WITH {FUNNEL} SELECT * FROM funnel")
def match_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return page_funnel(spark, folder)


@query("a04_run_diagnosis", f"""
    WITH {FUNNEL}
    SELECT page_id, CASE WHEN status >= 400 THEN 'http_error' WHEN kept = 0 AND selector_matches = 0 THEN 'selector_matched_nothing'
        WHEN kept = 0 THEN 'no_keyword_hit' WHEN new = 0 THEN 'nothing_new' ELSE 'ok' END AS diagnosis FROM funnel
""")
def run_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return page_funnel(spark, folder).select("page_id", signals.diagnosis().alias("diagnosis"))


@query("a04_page_outcomes", f"""
    WITH {FUNNEL}, judged AS (
        SELECT {HOST} AS host, CASE WHEN status >= 400 THEN 'http_error' WHEN kept = 0 AND selector_matches = 0 THEN 'selector_matched_nothing'
            WHEN kept = 0 THEN 'no_keyword_hit' WHEN new = 0 THEN 'nothing_new' ELSE 'ok' END AS outcome
        FROM funnel JOIN pages USING (page_id))
    SELECT host, outcome, count(*) AS pages FROM judged GROUP BY ALL
""")
def page_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of all pages, counted per host as a job."""
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return signals.page_outcomes(*[rows.withColumn("host", host) for rows in funnel_parts(spark, folder)], ["host"])


@query("l02_page_index", f"""
    WITH placed AS (SELECT job_id, ts_ns, ord, row_number() OVER (PARTITION BY job_id ORDER BY ts_ns DESC, ord DESC) AS place FROM ({RECORDS_SQL})),
    pages AS (SELECT job_id, (place - 1) // 20 + 1 AS page, count(*) AS rows FROM placed GROUP BY ALL)
    SELECT p.job_id, page, rows, ts_ns AS after, ord AS after_ord
    FROM pages p LEFT JOIN placed q ON q.job_id = p.job_id AND q.place = (page - 1) * 20
""")
def page_index(spark: SparkSession, folder: str) -> DataFrame:
    return records.page_index(document_records(spark, folder), 20).drop("after_hash")


@query("a05_header_flatten", f"""
    SELECT page_id, {HOST} || ', a=1, ' || page_id AS cookie, 'text/html' AS content_type, CAST(2 AS INTEGER) AS names FROM pages
""")
def header_flatten(spark: SparkSession, folder: str) -> DataFrame:
    def header(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    headers = F.array(
        header("set-cookie", F.regexp_extract("url", "://([^/]*)", 1)), header("content-type", F.lit("text/html")),
        header("set-cookie", F.lit("a=1")), header("set-cookie", F.col("page_id").cast("string")),
    )
    flat = scan(spark, folder, "pages").select("page_id", flatten_headers(headers).alias("h"))
    return flat.select(
        "page_id", F.col("h")["set-cookie"].alias("cookie"), F.col("h")["content-type"].alias("content_type"), F.size("h").alias("names")
    )


STAGE_NAMES = ", ".join(f"({at}, '{name}', '{kind}')" for at, (name, kind) in enumerate(signals.STAGES, 1))


@query("a07_stage_summary", f"""
    WITH stages(stage_no, stage, kind) AS (VALUES {STAGE_NAMES}),
    measured AS (
        SELECT event_id AS run, CASE event_type WHEN 'view' THEN 'fetch' WHEN 'click' THEN 'extract' WHEN 'signup' THEN 'store' WHEN 'error' THEN 'filter' ELSE 'webhook' END AS stage,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value * 20 AS duration_ms FROM events),
    all_rows AS (
        SELECT r.event_id AS run, CAST(s.stage_no AS INTEGER) AS stage_no, s.stage, s.kind, coalesce(m.status, 'inactive') AS status, coalesce(m.duration_ms, 0) AS ms
        FROM events r CROSS JOIN stages s LEFT JOIN measured m ON m.run = r.event_id AND m.stage = s.stage)
    SELECT stage_no, stage, kind, status, count(*) AS runs,
           count(*) FILTER (WHERE status <> 'inactive' AND ms > 5000) AS very_slow,
           count(*) FILTER (WHERE status <> 'inactive' AND ms > 1000 AND ms <= 5000) AS slow
    FROM all_rows GROUP BY ALL
""")
def stage_summary(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    stage = F.when(kind == "view", "fetch").when(kind == "click", "extract").when(kind == "signup", "store").when(kind == "error", "filter")
    measured = scan(spark, folder, "events").select(
        F.col("event_id").alias("run"), stage.otherwise("webhook").alias("stage"),
        F.when(kind == "error", "error").otherwise("success").alias("status"), (F.col("value") * 20).alias("duration_ms"),
        F.when(kind == "error", "odd thing").alias("error"),
    )
    rows = signals.stage_summary(measured, ["run"])
    return rows.groupBy("stage_no", "stage", "kind", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("speed") == "very_slow").alias("very_slow"),
        F.count_if(F.col("speed") == "slow").alias("slow"),
    )


@query("s05_csv_read", """SELECT doc_id, md5("text") AS text_md5, source, lang, n_chars FROM documents""")
def csv_read(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts written to CSV and read back."""
    path = f"{scratch(spark)}/docs.csv"
    files.write_file(scan(spark, folder, "documents").select("doc_id", "text", "source", "lang", "n_chars"), path, "overwrite")
    rows = files.read_file(spark, path, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "source", "lang", "n_chars")


@query("s06_binary_read", "SELECT c_custkey || '|' || c_name || '|' || c_nationkey || '|' || c_mktsegment AS line FROM customer")
def binary_read(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch(spark)
    files.write_file(scan(spark, folder, "customer").select(F.concat_ws("|", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")), f"{base}/names.txt", "overwrite")
    parts = files.read_binary(spark, f"{base}/names.txt", ["txt"])
    # Every line ends with a line feed, so what comes after the last one is empty.
    return parts.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")


@query("s07_append_and_overwrite", """
    SELECT 'append' AS how, 2 * count(*) AS n FROM customer UNION ALL SELECT 'overwrite', count(*) FROM customer
""")
def append_and_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch(spark)
    rows = scan(spark, folder, "customer").select("c_custkey", "c_name")
    counts = None
    for mode in ("append", "overwrite"):
        for _ in range(2):
            files.write_file(rows, f"{base}/{mode}.jsonl", mode)
        back = files.read_file(spark, f"{base}/{mode}.jsonl", "c_custkey bigint, c_name string")
        found = back.agg(F.lit(mode).alias("how"), F.count("c_custkey").alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    return counts


@query("s08_record_sink", """
    WITH h AS (SELECT source, "text", doc_id % 2 AS batch, doc_id FROM documents)
    SELECT batch AS batch_id, source AS job_id, count(*) AS n FROM h
    WHERE NOT EXISTS (SELECT 1 FROM h e WHERE e."text" = h."text" AND (e.batch < h.batch OR e.batch = h.batch AND e.doc_id < h.doc_id)) GROUP BY batch, source
""")
def record_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches stored one after the other, the second one twice; a repeat changes nothing."""
    store = RecordStore(spark, scratch(spark))
    items = hashed(document_items(spark, folder), ["text"]).withColumn("matches", F.array().cast("array<string>"))
    for batch in (0, 1, 1):
        store.add(items.where(F.pmod("page_id", F.lit(2)) == batch), batch, F.lit(batch))
    return store.records().groupBy("batch_id", "job_id").agg(F.count(F.lit(1)).alias("n"))


@query("s09_webhook_outbox", """
    SELECT CAST(conv_id AS VARCHAR) AS job_id, count(*) AS item_count, count(*) AS items FROM conversations GROUP BY conv_id
""")
def webhook_outbox(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch(spark)
    write_outbox(digest.webhook_payloads(turn_items(spark, folder), ["turn"]), base, "webhooks", 1)
    sent = spark.read.schema("job_id string, item_count bigint, payload string").json(f"{base}/webhooks/batch_id=1")
    return sent.select("job_id", "item_count", F.size(F.from_json("payload", "items array<struct<role:string>>")["items"]).cast("bigint").alias("items"))


@query("s10_notification_outbox", f"SELECT job_id, job_name, title, body FROM ({DIGEST_SQL})")
def notification_outbox(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch(spark)
    write_outbox(digest.digests(turn_items(spark, folder), ["turn"], ["role", "text"]), base, "notifications", 1)
    return spark.read.schema("job_id string, job_name string, title string, body string").json(f"{base}/notifications/batch_id=1")


@query("s11_debug_artefacts", f"""
    SELECT i.page_id, item_ord, '<li><a href="' || href || '">' || txt || '</a></li>' AS parent_html, md5(html) AS page_md5
    FROM ({sql.LIST_ITEMS}) i JOIN pages p ON p.page_id = i.page_id
""")
def debug_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """Items with their provenance and the whole bodies of their pages, written and read back."""
    base = scratch(spark)
    spec = JobSpec("Debug", "https://monitor.example.com", "nav li", ["text:a", "link:a@href"], debug=True)
    pages = scan_pages(spark, folder)
    write_debug(extract_items(pages, spec), base, 1, pages.select("page_id", "url", "html"))
    items = spark.read.schema("page_id bigint, item_ord int, parent_html string").json(f"{base}/debug/batch_id=1")
    bodies = spark.read.schema("page_id bigint, html string").parquet(f"{base}/debug_pages/batch_id=1")
    return items.join(bodies.select("page_id", F.md5("html").alias("page_md5")), "page_id").select("page_id", "item_ord", "parent_html", "page_md5")
