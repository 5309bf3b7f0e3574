"""Queries for change signals and key-value state: windows, sequential state, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.functions import text
from pagewatch.operators import signals, state
from pagewatch.plans.registry import query
from pagewatch.plans.samples import ATTEMPTS_SQL, document_records, event_attempts
from pagewatch.sources.pages import scan

UNIT_PRICE = "l_extendedprice / l_quantity"

PRICES_SQL = f"""
    SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, {UNIT_PRICE} AS price,
           CASE l_returnflag WHEN 'R' THEN 'big sale' WHEN 'A' THEN 'ten % off' ELSE 'plain' END AS title FROM lineitem
"""
PRICE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]


def priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return scan(spark, folder, "lineitem").select(
        "l_partkey", *PRICE_ORDER, (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(flag == "R", "big sale").when(flag == "A", "ten % off").otherwise("plain").alias("title"),
    )


PRICE_ALERTS_SQL = f"""
    SELECT l_partkey, l_orderkey, l_linenumber, price, prior_min,
           CASE WHEN price > 0 AND price < prior_min THEN 'price_drop' WHEN title <> 'plain' THEN 'sale' END AS alert
    FROM (SELECT *, least(coalesce(min(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999999), 999999) AS prior_min FROM ({PRICES_SQL}))
"""


@query("w02_price_drops", PRICE_ALERTS_SQL)
def price_drops(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals.price_alerts(priced_lines(spark, folder), "l_partkey", PRICE_ORDER, F.col("price"), F.col("title"))
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", "price", "prior_min", "alert")


@query("w02_price_drops_hot_key", f"""
    SELECT l_orderkey, l_linenumber, prior_min FROM (
        SELECT l_orderkey, l_linenumber, least(coalesce(min(CASE WHEN price > 0 THEN price END) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999999), 999999) AS prior_min, price FROM ({PRICES_SQL})) WHERE price < prior_min
""")
def price_drops_hot_key(spark: SparkSession, folder: str) -> DataFrame:
    """All lines under one key, worked in pieces."""
    lines = priced_lines(spark, folder).withColumn("everything", F.lit("all"))
    rows = signals.price_alerts(lines, "everything", [*PRICE_ORDER, "l_partkey"], F.col("price"), group_rows=2000)
    return rows.where(F.col("alert") == "price_drop").select("l_orderkey", "l_linenumber", "prior_min")


@query("w03_failure_streaks", """
    WITH a AS (SELECT *, event_type = 'error' AS failed, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
    SELECT event_id, count(*) FILTER (WHERE failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM a
""")
def failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return signals.failure_streaks(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak")


RULES = signals.BreakerRules(alert_at=2, stop_at=4, cooldown=12 * 3600)


def breaker_input(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts with whole-second times; a view whose k ends in 0 found nothing on the page."""
    rows = event_attempts(spark, folder)
    matches = F.when(F.pmod("k", F.lit(10)) == 0, 0).otherwise(3)
    return rows.select(
        "attempt_id", "job_id", text.wall_seconds(F.col("ts")).alias("time"), "status",
        F.col("error").isNotNull().alias("failed"), matches.alias("selector_matches"),
    )


BREAKER_SQL = f"""
    WITH RECURSIVE a AS (
        SELECT attempt_id, job_id, CAST(floor(epoch(ts)) AS BIGINT) AS time, status, error IS NOT NULL AS failed, CASE WHEN k % 10 = 0 THEN 0 ELSE 3 END AS found,
               row_number() OVER (PARTITION BY job_id ORDER BY ts, attempt_id) AS n FROM ({ATTEMPTS_SQL})),
    walk AS (
        SELECT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS attempt_id, CAST(0 AS BIGINT) AS fails, CAST(0 AS BIGINT) AS stop,
               CAST('' AS VARCHAR) AS action, CAST('' AS VARCHAR) AS alerts FROM (SELECT DISTINCT job_id FROM a)
        UNION ALL
        SELECT job_id, n, attempt_id,
               CASE WHEN skip THEN fails WHEN bad AND coalesce(status, 0) = 403 THEN 4 WHEN bad AND coalesce(status, 0) = 404 THEN fails WHEN bad THEN fails + 1 WHEN found = 0 THEN 4 ELSE 0 END,
               CASE WHEN skip THEN stop WHEN bad AND coalesce(status, 0) = 403 THEN time WHEN bad AND coalesce(status, 0) = 404 THEN gate
                    WHEN bad THEN CASE WHEN fails + 1 = 4 THEN time ELSE gate END WHEN found = 0 THEN time ELSE 0 END,
               CASE WHEN skip THEN 'skipped' WHEN fails >= 4 THEN 'probe' ELSE 'fetched' END,
               CASE WHEN skip THEN '' WHEN bad AND coalesce(status, 0) = 403 THEN 'banned' WHEN bad AND coalesce(status, 0) = 404 THEN 'missing'
                    WHEN bad THEN CASE fails + 1 WHEN 2 THEN 'failing' WHEN 4 THEN 'stopped' ELSE '' END
                    ELSE concat_ws(',', CASE WHEN fails >= 2 THEN 'recovered' END, CASE WHEN found = 0 THEN 'layout' END) END
        FROM (SELECT a.job_id, a.n, a.attempt_id, a.time, a.status, a.found, w.fails, w.stop, w.fails >= 4 AND a.time - w.stop < 43200 AS skip,
                     a.failed OR coalesce(a.status, 0) <> 200 AS bad, CASE WHEN w.fails >= 4 THEN a.time ELSE w.stop END AS gate
              FROM walk w JOIN a ON a.job_id = w.job_id AND a.n = w.n + 1) AS step)
    SELECT attempt_id, action, alerts, CAST(fails AS BIGINT) AS fail_count FROM walk WHERE n > 0
"""


@query("t03_circuit_breaker", BREAKER_SQL)
def circuit_breaker(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals.circuit_breaker(breaker_input(spark, folder), "job_id", ["time", "attempt_id"], RULES)
    return rows.select("attempt_id", "action", "alerts", F.col("fail_count").cast("bigint").alias("fail_count"))


HEARTBEATS_SQL = """
    WITH RECURSIVE a AS (
        SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS time, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    walk AS (
        SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS last, false AS beat FROM (SELECT DISTINCT user_id FROM a)
        UNION ALL
        SELECT a.user_id, a.n, a.event_id, CASE WHEN a.time - w.last >= 86400 THEN a.time ELSE w.last END, a.time - w.last >= 86400
        FROM walk w JOIN a ON a.user_id = w.user_id AND a.n = w.n + 1)
    SELECT event_id, user_id FROM walk WHERE beat
"""


@query("t05_heartbeats", HEARTBEATS_SQL)
def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    ticks = scan(spark, folder, "events").select("event_id", "user_id", text.wall_seconds(F.col("ts")).alias("time"))
    return signals.heartbeats(ticks, "user_id", ["time", "event_id"], "time").where("beat").select("event_id", "user_id")


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as operations on ten keys per user group: views set, clicks add, signups delete."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    op = F.when(kind == "view", "set").when(kind == "signup", "delete").otherwise("incr")
    value = F.when(kind == "view", F.when(k < 20, F.concat(F.lit("text "), k.cast("string"))).otherwise(k.cast("string")))
    scope = F.when(F.pmod("user_id", F.lit(3)) > 0, F.concat(F.lit("job"), F.pmod("user_id", F.lit(3)).cast("string")))
    key = state.scoped_key(scope, F.concat(F.lit("k"), F.pmod("user_id", F.lit(50)).cast("string")))
    return scan(spark, folder, "events").select(
        F.col("event_id").alias("seq"), key.alias("key"), op.alias("op"), value.alias("value"), k.alias("default"),
        F.floor("value").cast("bigint").alias("delta"),
    )


OPERATIONS_SQL = """
    SELECT event_id AS seq, CASE WHEN user_id % 3 > 0 THEN 'job' || user_id % 3 || ':' ELSE '' END || 'k' || user_id % 50 AS key,
           CASE event_type WHEN 'view' THEN 'set' WHEN 'signup' THEN 'delete' ELSE 'incr' END AS op, k AS "default", CAST(floor(value) AS BIGINT) AS delta,
           CASE WHEN event_type = 'view' THEN CASE WHEN k < 20 THEN 'text ' || k ELSE CAST(k AS VARCHAR) END END AS value
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""


@query("k01_current_values", f"""
    SELECT key, arg_max(value, seq) AS value FROM ({OPERATIONS_SQL}) WHERE op <> 'incr' GROUP BY key HAVING arg_max(op, seq) = 'set'
""")
def current_values(spark: SparkSession, folder: str) -> DataFrame:
    return state.current_values(operations(spark, folder))


FOLDED_SQL = f"""
    WITH ops AS ({OPERATIONS_SQL}),
    resets AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM ops WHERE op <> 'incr' GROUP BY key),
    adds AS (
        SELECT o.key, sum(o.delta) AS added, arg_min(o."default", o.seq) AS first_default FROM ops o LEFT JOIN resets r ON r.key = o.key
        WHERE o.op = 'incr' AND o.seq > coalesce(r.seq, -1) GROUP BY o.key),
    merged AS (
        SELECT coalesce(a.key, r.key) AS key, CASE WHEN r.op = 'set' THEN r.value END AS held, a.added, a.first_default
        FROM adds a FULL OUTER JOIN resets r ON r.key = a.key)
    SELECT key, CASE WHEN added IS NULL THEN held ELSE CAST(coalesce(try_cast(held AS BIGINT), first_default) + CAST(added AS BIGINT) AS VARCHAR) END AS value
    FROM merged WHERE added IS NOT NULL OR held IS NOT NULL
"""


@query("k02_counters", FOLDED_SQL)
def counters(spark: SparkSession, folder: str) -> DataFrame:
    return state.folded(operations(spark, folder))


@query("k02_counters_in_pieces", FOLDED_SQL)
def counters_in_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The same fold with keys cut into pieces, as for a key that is too large for one task."""
    return state.folded(operations(spark, folder), group_rows=50)


@query("k03_state_snapshot", f"WITH folded AS ({FOLDED_SQL}) SELECT key, value FROM folded WHERE starts_with(key, 'job1:')")
def state_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return state.snapshot(state.folded(operations(spark, folder)), "job1")


@query("c02_utc_text", """
    SELECT doc_id AS ord, strftime(make_timestamp((doc_id // 10 + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS date_time FROM documents
""")
def utc_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_records(spark, folder)
    return rows.select("ord", text.nanos_to_utc(F.col("ts_ns") + 999_999_999).alias("date_time"))


@query("c03_duration_text", """
    SELECT event_id, CASE WHEN round(value * 20) >= 1000 THEN printf('%.2fs', round(value * 20) / 1000) ELSE printf('%.2fms', round(value * 20) / 1.0) END AS duration FROM events
""")
def duration_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").select("event_id", text.duration_text(F.round(F.col("value") * 20)).alias("duration"))


@query("c05_failure_breakdown", f"""
    SELECT job_id, CASE k % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'dns' WHEN 2 THEN 'http' WHEN 3 THEN 'tls' WHEN 4 THEN 'proxy' WHEN 5 THEN 'connect' WHEN 6 THEN 'size' WHEN 7 THEN 'blocked' ELSE 'unknown' END AS kind,
           count(*) AS n FROM ({ATTEMPTS_SQL}) WHERE error IS NOT NULL GROUP BY job_id, kind
""")
def failure_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    failed = event_attempts(spark, folder).where(F.col("error").isNotNull())
    return failed.groupBy("job_id", text.failure_kind(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
