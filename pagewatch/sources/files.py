"""Plain files next to the tables: text, JSON and CSV in, the same out, and binary files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# File types that may be read and written, and types that may be read as bytes.
TEXT_TYPES = ["csv", "json", "jsonl", "txt", "log"]
BINARY_TYPES = [
    "csv", "json", "jsonl", "txt", "log", "png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "ico",
    "woff", "woff2", "ttf", "otf", "pdf", "zip",
]

LINE = T.StructType().add("value", T.StringType())
# How CSV is written and read, so that every text comes back: quotes are doubled, edge spaces and line breaks are kept,
# the empty text is quoted and NULL is nothing at all.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""', "nullValue": ""}
# Stands for a quoted empty text while a file is read, since the reader takes one that is "" for NULL.
EMPTY = "\u0001empty\u0001"


# Rows of one CSV file that this module writes.
CSV_ROWS = 200_000


def extension(path: str, allowed: list[str]) -> str:
    kind = PurePosixPath(path).suffix.lstrip(".").lower()
    if kind not in allowed:
        raise ValueError(f"{path}: only {', '.join(allowed)} files are allowed")
    return kind


def read_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A csv, json, jsonl, txt or log file (or folder of that name); an empty table when there is none."""
    kind = extension(path, TEXT_TYPES)
    reader = spark.read if schema is None or kind in ("txt", "log") else spark.read.schema(schema)
    try:
        if kind == "csv":
            # A quoted text may hold line breaks, so a file is read by one task; ``write_file`` cuts its output by rows.
            rows = reader.options(**{**CSV, "emptyValue": EMPTY}, multiLine=True).csv(path)
            texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
            return rows.withColumns({c: F.when(F.col(f"`{c}`") == EMPTY, "").otherwise(F.col(f"`{c}`")) for c in texts})
        if kind in ("json", "jsonl"):
            return reader.json(path)
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema or LINE)


def read_binary(spark: SparkSession, folder: str, kinds: list[str] | None = None) -> DataFrame:
    """Binary files of a folder with path, time, length and content."""
    wanted = kinds or BINARY_TYPES
    for kind in wanted:
        extension(f"x.{kind}", BINARY_TYPES)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").load(folder)


def write_file(df: DataFrame, path: str, mode: str = "append", stamp: bool = False) -> None:
    """Append to or replace a folder of csv, json or text part files; ``stamp`` puts the time in front of log lines."""
    kind = extension(path, TEXT_TYPES)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.options(**CSV, maxRecordsPerFile=CSV_ROWS).csv(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    else:
        line = F.col(df.columns[0])
        text = F.concat(F.lit("["), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("] "), line) if stamp else line
        df.select(text.alias("value")).write.mode(mode).text(path)


def json_intake(rows: DataFrame, column: str, limit: int = 10_000_000) -> DataFrame:
    """Add ``parsed`` (a variant) and ``problem``: text over the limit or not JSON is set aside with its reason."""
    text = F.col(column)
    too_large = F.octet_length(text) > limit
    parsed = F.when(~too_large, F.try_parse_json(text))
    checked = rows.withColumn("parsed", parsed)
    problem = F.when(too_large, f"input exceeds {limit} bytes").when(F.col("parsed").isNull(), "not valid JSON")
    return checked.withColumn("problem", problem)


def json_lines(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as JSON text; array columns stay arrays, also when empty."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("value"))


def split_problems(rows: DataFrame, problem: str = "problem") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(problem).isNull()).drop(problem), rows.where(F.col(problem).isNotNull())
