"""The monitor cycle over a stream of pages, and exact dedup of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagewatch.operators.dedup import hash_items
from pagewatch.operators.extract import extract_items
from pagewatch.plans.cycle import Cycle
from pagewatch.spec import JobSpec


def stream_pages(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def monitor(pages: DataFrame, cycle: Cycle, checkpoint: str, every: str | None = None, ts_ns: Column | None = None) -> StreamingQuery:
    """Run the cycle on every micro-batch: each ``every`` (such as '600 seconds'), or once over what is there.

    A micro-batch that is repeated after a failure has the same number and overwrites what it wrote before.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        counts = cycle.run(batch, batch_id, ts_ns)
        if cycle.hooks.on_finished and counts is not None:
            cycle.hooks.on_finished(counts)

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def stream_new_items(
    pages: DataFrame, spec: JobSpec, event_time: str | None = None, horizon: str | None = None, scope: str = "global"
) -> DataFrame:
    """Items of a page stream, each content once.

    Without a horizon every hash is remembered for good, as exact as the batch form. With one, state older than
    ``horizon`` of ``event_time`` is dropped, and a content that comes back after that counts as new again.
    """
    keys = ["hash"] if scope == "global" else ["job_id", "hash"]
    items = hash_items(extract_items(pages, spec), spec)
    if event_time and horizon:
        return items.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)
    return items.dropDuplicates(keys)
