"""Where a run leaves its results: records, outbox rows and debug artefacts.

Every write of a run goes to a folder named after its batch and replaces what is there, so a run that is repeated after
a failure leaves the same files and nothing twice.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.operators.dedup import as_records, new_items, seen_among, seen_of

RECORD_SCHEMA = (
    "job_id string, fields map<string,string>, ts_ns bigint, page_id bigint, ord bigint, hash string, "
    "match_key array<string>, batch_id bigint"
)


class RecordStore:
    """Records in parquet, partitioned by batch and job; the seen hashes are read from the records themselves."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def records(self, before_batch: int | None = None) -> DataFrame:
        """All records, or those of earlier batches."""
        try:
            rows = self.spark.read.schema(RECORD_SCHEMA).parquet(f"{self.folder}/records")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], RECORD_SCHEMA)
        return rows if before_batch is None else rows.where(F.col("batch_id") < before_batch)

    def stamp(self, batch_id: int) -> int:
        """The time of a batch in nanoseconds: the clock when the batch is first seen, and the same when it is repeated."""
        path = f"{self.folder}/stamps/batch_id={batch_id}"
        try:
            known = self.spark.read.schema("ts_ns bigint").json(path).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None
        if known is None:
            known = (time.time_ns(),)
            self.spark.createDataFrame([known], "ts_ns bigint").coalesce(1).write.mode("overwrite").json(path)
        return known[0]

    def add(self, items: DataFrame, batch_id: int, ts_ns: Column, scope: str = "global") -> DataFrame:
        """Store the new items of a batch and return them as stored. Replaying a batch gives the same result.

        Newest records come first in every file, so a page of the newest ones reads little. ``items`` are read more than
        once and should be stored already.
        """
        keys = ["hash"] if scope == "global" else ["job_id", "hash"]
        seen = seen_among(seen_of(self.records(batch_id), scope), items, keys)
        new = new_items(items, seen, ["page_id", "item_ord", "job_id"], scope)
        target = f"{self.folder}/records/batch_id={batch_id}"
        # Rebalancing puts a job's records together but splits a job that is too large for one task.
        records = as_records(new, ts_ns, extra=["page_id"]).hint("rebalance", "job_id")
        records.sortWithinPartitions("job_id", F.desc("ts_ns"), F.desc("ord")).write.mode("overwrite").partitionBy("job_id").parquet(target)
        return self.batch(batch_id)

    def batch(self, batch_id: int) -> DataFrame:
        return self.records().where(F.col("batch_id") == batch_id)


def write_outbox(rows: DataFrame, folder: str, name: str, batch_id: int) -> None:
    """Notification or webhook rows as JSON lines; delivery is somebody else's work."""
    rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}/batch_id={batch_id}")


def write_debug(items: DataFrame, folder: str, batch_id: int, pages: DataFrame | None = None) -> None:
    """Items with their provenance, one folder per job, and the bodies of the pages that they come from."""
    if pages is not None:
        pages.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/debug_pages/batch_id={batch_id}")
    items.hint("rebalance", "job_id").write.mode("overwrite").partitionBy("job_id").json(f"{folder.rstrip('/')}/debug/batch_id={batch_id}")
