"""Session settings and durable intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


# A side table is broadcast only when it is known to have at most this many rows; above that the join shuffles.
BROADCAST_ROWS = 100_000


def build_session(app: str = "pagewatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def give_back() -> None:
    """Return the memory that Arrow and the C library keep for later: a worker that waits idle takes room that others need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` at a reliable checkpoint in the folder the session names.

    A lost executor then re-reads the checkpoint files instead of repeating the plan, and values that depend on
    where a row landed (a partition number) keep the value they were first given.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set up on first use. Only a local session may fall back to its own disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
            named = tempfile.mkdtemp(prefix="pagewatch-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder for files of one run, below the checkpoint folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else ``df`` itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
