"""A batch of pages through all jobs of a specification table: one reading, one dedup, one store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions.text import job_id
from pagewatch.operators import jobs as many
from pagewatch.operators.digest import webhook_payloads
from pagewatch.operators.filters import enabled
from pagewatch.operators.signals import diagnosis, funnel
from pagewatch.session import durable, small
from pagewatch.sources.pages import guarded
from pagewatch.sources.sinks import RecordStore, write_outbox


@dataclass
class ManyJobs:
    """The enabled jobs of ``jobs`` over batches of ``pages(page_id, url, html)`` with, if known, ``status`` and ``error``.

    What is new is decided once for the batch: with ``scope='global'`` an item that several jobs find belongs to the first by
    (page_id, item_ord, job_id), with ``scope='job'`` to each. Hooks and notification templates belong to one job: ``Cycle``.
    """

    jobs: DataFrame
    store: RecordStore
    scope: str = "global"

    def run(self, pages: DataFrame, batch_id: int, ts_ns: Column | None = None) -> DataFrame:
        """Run one batch; the counts of every enabled job: ``pages``, ``failed``, ``selector_matches``, ``kept``, ``new`` and its
        diagnosis. Rejected pages go to the ``rejected`` outbox once, and count for every job that wanted them."""
        running = durable(enabled(self.jobs))
        layouts = many.layouts_of(running)
        names = running.select(job_id(F.col("name")).alias("job_id"), F.coalesce("webhook.enabled", F.lit(False)).alias("hooked"))
        if not layouts:
            return names.selectExpr("job_id", *[f"0L AS {c}" for c in ("pages", "failed", "selector_matches", "kept", "new")], "'' AS diagnosis")
        wanted = durable(many.routing(running, layouts))
        attempts = self._checked(pages)
        read = durable(many.read_pages(attempts.where("error_kind IS NULL").drop("error_kind", "error"), wanted, layouts))
        asked = small(wanted.select("job_id", "url", "layout"))
        tried = attempts.drop("html").join(asked, "url")
        failures = durable(tried.where("error_kind IS NOT NULL"))
        write_outbox(failures.drop("job_id", "layout").dropDuplicates(["page_id"]), self.store.folder, "rejected", batch_id)
        kept = durable(many.kept_items(read, wanted))
        stamp = F.lit(self.store.stamp(batch_id)) if ts_ns is None else ts_ns
        new = self.store.add(kept, batch_id, stamp, self.scope)
        told = new.join(small(names.where("hooked").select("job_id")), "job_id", "left_semi")
        if not told.isEmpty():
            rows = told.withColumns({"job_name": F.col("job_id"), "matches": F.col("match_key")})
            write_outbox(webhook_payloads(rows, ["ts_ns", "page_id", "ord"]), self.store.folder, "webhooks", batch_id)
        found = read.select("url", "layout", "status", "selector_matches").join(asked, ["url", "layout"])
        counts = funnel(found, kept, new, new.limit(0), ["job_id"]).drop("notified")
        answered = found.groupBy("job_id").agg(F.count(F.lit(1)).alias("_answered"))
        failed = failures.groupBy("job_id").agg(F.count(F.lit(1)).alias("failed"))
        numbers = ["failed", "_answered", "selector_matches", "kept", "new"]
        per_job = names.select("job_id").join(counts, "job_id", "left").join(answered, "job_id", "left").join(failed, "job_id", "left").fillna(0, numbers)
        said = F.when(F.col("_answered") > 0, diagnosis()).when(F.col("failed") > 0, "all_failed").otherwise("no_pages")
        return per_job.select("job_id", (F.col("_answered") + F.col("failed")).alias("pages"), "failed", "selector_matches", "kept", "new", said.alias("diagnosis"))

    @staticmethod
    def _checked(pages: DataFrame) -> DataFrame:
        """All attempts with ``status``, ``error_kind`` and ``error``."""
        if "status" not in pages.columns:
            pages = pages.withColumn("status", F.lit(200))
        if "error" not in pages.columns:
            pages = pages.withColumn("error", F.lit(None).cast("string"))
        checked = guarded(pages.withColumnRenamed("error", "_failed"))
        kind = F.when(F.col("_failed").isNotNull(), "fetch").otherwise(F.col("error_kind"))
        return checked.withColumns({"error_kind": kind, "error": F.coalesce("_failed", "error")}).drop("_failed")
