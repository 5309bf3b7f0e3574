"""Items, records, attempts and targets read out of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.operators.dedup import hashed
from pagewatch.sources.pages import scan
from pagewatch.spec import JobSpec

DOCUMENTS = JobSpec(
    "Documents", "https://monitor.example.com", "article", ["text:p", "lang:html@lang", "source:footer"],
    keywords=["The ", "LES", " ", "und", "zzz"], search_fields=["text", "lang"],
)
# Time of the first record, in seconds.
EPOCH = 1_700_000_000


def string_map(**values: Column) -> Column:
    return F.create_map(*[part for name, value in values.items() for part in (F.lit(name), value)])


def document_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an item of the job named like its source."""
    fields = string_map(text=F.col("text"), lang=F.col("lang"), source=F.col("source"))
    return scan(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit(0).alias("item_ord"), F.col("source").alias("job_id"), fields.alias("fields")
    )


def document_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as stored records; ten share a time, so ord has to break ties."""
    items = hashed(document_items(spark, folder), ["lang", "source"])
    return items.select(
        "job_id", "fields", ((F.floor(F.col("page_id") / 10) + EPOCH) * 1_000_000_000).cast("bigint").alias("ts_ns"),
        F.col("page_id").alias("ord"), "hash", F.array(F.element_at("fields", F.lit("lang"))).alias("match_key"),
    )


RECORDS_SQL = f"""
    SELECT source AS job_id, (doc_id // 10 + {EPOCH}) * 1000000000 AS ts_ns, doc_id AS ord, text, lang, source FROM documents
"""


def event_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as fetch attempts of the job named by the user: errors failed, other types answered with a status."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(kind == "error", None).when(kind == "purchase", F.when(k < 10, 403).otherwise(404))
        .when(kind == "click", F.when(k < 50, 500).otherwise(200)).when(kind == "signup", 204).otherwise(200)
    )
    messages = F.array(*[F.lit(m) for m in MESSAGES])
    error = F.when(kind == "error", F.get(messages, F.pmod(k, F.lit(len(MESSAGES)))))
    return scan(spark, folder, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("job_id"), "ts",
        F.concat(F.lit("https://h.example.com/"), k.cast("string")).alias("url"), status.alias("status"), error.alias("error"),
        (F.col("value") * 1000).alias("time_ms"), k.alias("k"),
    )


MESSAGES = [
    "Request timed out", "DNS lookup failed", "HTTP status: 502", "tls handshake eof", "Proxy refused", "connection reset",
    "body exceeds limit", "blocked private network address 10.0.0.1", "odd thing",
]

ATTEMPTS_SQL = f"""
    SELECT event_id AS attempt_id, user_id AS job_id, ts, k, value * 1000 AS time_ms,
           'https://h.example.com/' || k AS url,
           CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN CASE WHEN k < 10 THEN 403 ELSE 404 END
                WHEN 'click' THEN CASE WHEN k < 50 THEN 500 ELSE 200 END WHEN 'signup' THEN 204 ELSE 200 END AS status,
           CASE WHEN event_type = 'error' THEN ([{', '.join(f"'{m}'" for m in MESSAGES)}])[k % {len(MESSAGES)} + 1] END AS error
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as monitored targets."""
    key = F.col("c_custkey")
    return scan(spark, folder, "customer").select(
        key.cast("string").alias("id"), F.concat(F.lit("https://t.example.com/"), key.cast("string")).alias("url"),
        (F.pmod(key * 37, F.lit(1000)) + 60).alias("interval_sec"), F.pmod(key * 91, F.lit(2000)).alias("last_check"),
        F.col("c_mktsegment").alias("segment"),
    )


TARGETS_SQL = """
    SELECT CAST(c_custkey AS VARCHAR) AS id, 'https://t.example.com/' || c_custkey AS url, c_custkey * 37 % 1000 + 60 AS interval_sec,
           c_custkey * 91 % 2000 AS last_check, c_mktsegment AS segment FROM customer
"""
