"""Page and crawl-log scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.functions.text import failure_kind

# Fixed value: the largest page body that is accepted, in bytes.
BODY_LIMIT = 10 * 1024 * 1024


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


# Pages that Spark hands to a Python worker at a time, by rows and by bytes. Its own default, 10,000 rows, is meant for short rows.
PAGE_ROWS, PAGE_BYTES = 256, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of pages takes, in the session of the caller; what is set lower stays."""
    for name, most in (("maxRecordsPerBatch", PAGE_ROWS), ("maxBytesPerBatch", PAGE_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def scan_pages(spark: SparkSession, folder: str, table: str = "pages", key: str = "page_id") -> DataFrame:
    """Pages for parsing. A table with fewer file splits than cores is spread, since parsing is the costly part."""
    short_batches(spark)
    pages = scan(spark, folder, table)
    cores = spark.sparkContext.defaultParallelism
    return pages.repartition(cores, key) if pages.rdd.getNumPartitions() < cores else pages


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def attempts(log: DataFrame) -> DataFrame:
    """Fetch attempts in one shape: a response or an error text, never both, an ``ok`` flag, and for those that are not ok a
    ``failure`` with message and kind, which is ``http`` where an answer has another status than 200 to 299."""
    answered = F.col("error").isNull()
    response = F.struct(*[c for c in ("url", "status", "headers", "body", "proxy", "time_ms", "size") if c in log.columns])
    ok = F.coalesce(answered & is_success(F.col("status")), F.lit(False))
    told = F.struct(F.col("error").alias("message"), failure_kind(F.col("error")).alias("kind"))
    status = F.coalesce(F.col("status").cast("string"), F.lit("none"))
    refused = F.struct(F.concat(F.lit("http status: "), status).alias("message"), F.lit("http").alias("kind"))
    return log.withColumns({"response": F.when(answered, response), "ok": ok, "failure": F.when(~answered, told).when(~ok, refused)})


def guarded(pages: DataFrame, body: str = "html", limit: int = BODY_LIMIT) -> DataFrame:
    """Flag bodies that are over the limit or not UTF-8; they are set aside whole, never cut."""
    column = F.col(body)
    too_large = F.octet_length(column) > limit
    kind = F.when(too_large, "size").when(~F.is_valid_utf8(column.cast("string")), "encoding")
    message = F.when(too_large, F.format_string("response body exceeds %d bytes", F.lit(limit))).when(
        kind == "encoding", "response body is not valid UTF-8"
    )
    return pages.withColumns({"error_kind": kind, "error": message})


def accepted(pages: DataFrame, body: str = "html", limit: int = BODY_LIMIT) -> DataFrame:
    return guarded(pages, body, limit).where(F.col("error_kind").isNull()).drop("error_kind", "error")


def quarantined(pages: DataFrame, body: str = "html", limit: int = BODY_LIMIT) -> DataFrame:
    return guarded(pages, body, limit).where(F.col("error_kind").isNotNull()).drop(body)


def flatten_headers(headers: Column) -> Column:
    """array<struct<name,value>> to a map; values of a repeated name are joined in order."""
    names = F.array_distinct(F.transform(headers, lambda h: h["name"]))
    values = F.transform(
        names,
        lambda n: F.array_join(F.transform(F.filter(headers, lambda h: h["name"] == n), lambda h: h["value"]), ", "),
    )
    return F.map_from_arrays(names, values)
