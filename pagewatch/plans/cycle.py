"""The monitor cycle: pages in, records and outbox rows out, with a DataFrame function at every stage."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.operators.dedup import hash_items
from pagewatch.operators.digest import digests, webhook_payloads
from pagewatch.operators.extract import extract_pages, items_of
from pagewatch.operators.filters import filtered
from pagewatch.operators.frontier import admitted, push_counts, seed_batch
from pagewatch.operators.signals import diagnosis, funnel, page_outcomes
from pagewatch.session import durable, small
from pagewatch.sources.pages import guarded
from pagewatch.sources.sinks import RecordStore, write_debug, write_outbox
from pagewatch.spec import JobSpec

log = logging.getLogger(__name__)

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Hooks:
    """Functions from DataFrame to DataFrame. One that is missing adds nothing to the plan.

    None as an answer ends something: ``before_fetch`` and ``after_fetch`` the batch, ``override_fetch`` every attempt
    as failed, ``override_extract``, ``after_extract`` and ``filter_item`` leave no items, ``before_store`` stores
    nothing and tells nobody, ``before_notify`` and ``before_webhook`` send nothing of their kind.

    ``push`` is given the items that the extraction found and answers with a ``url`` column of pages to visit as well.
    Those that are new to the batch become rows of the ``pushed`` outbox, each once; the others count as duplicates.

    A function that raises leaves its input as it was, except that a failing ``override_fetch`` is a failed attempt for
    every page, a failing ``override_extract`` yields no items, and a failing ``push`` pushes nothing. That is seen while the plan is built; an error in
    a hook's expressions comes up while rows are computed, and fails the batch.
    """

    before_fetch: Stage | None = None
    override_fetch: Stage | None = None
    after_fetch: Stage | None = None
    override_extract: Stage | None = None
    after_extract: Stage | None = None
    filter_item: Stage | Column | None = None
    before_store: Stage | None = None
    before_notify: Stage | None = None
    before_webhook: Stage | None = None
    push: Stage | None = None
    on_start: Callable[[SparkSession], DataFrame | None] | None = None
    on_success: Callable[[DataFrame], None] | None = None
    on_error: Callable[[Exception], None] | None = None
    on_finally: Callable[[], None] | None = None
    on_finished: Callable[[DataFrame], None] | None = None


def applied(stage: Stage | None, rows: DataFrame) -> DataFrame | None:
    """What a hook makes of ``rows``; ``rows`` if there is no hook or it raises, None if it answers with nothing."""
    if stage is None:
        return rows
    try:
        return stage(rows)
    except Exception:
        log.exception("hook %s failed; its input is passed on", getattr(stage, "__name__", stage))
        return rows


def ended_as(counts: dict[str, int]) -> Column:
    pairs = [part for name, n in sorted(counts.items()) for part in (F.lit(name), F.lit(n).cast("bigint"))]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,bigint>")


NO_ITEMS = "page_id bigint, item_ord int, fields map<string,string>, job_id string, matches array<string>"
MEASURED = "array<struct<stage:string,status:string,duration_ms:double>>"


@dataclass
class Cycle:
    """One job over batches of pages.

    ``pages`` have ``page_id, url, html`` and, if known, ``status`` and ``error``. Items are ordered by
    (page_id, item_ord) wherever the first of several counts.
    """

    spec: JobSpec
    store: RecordStore
    hooks: Hooks = field(default_factory=Hooks)
    scope: str = "global"
    batch_limit: int | None = None

    def batch_urls(self, spark: SparkSession) -> DataFrame:
        urls = spark.createDataFrame([(u,) for u in self.spec.targets], "url string")
        return seed_batch(spark, urls, self.hooks.on_start, self.batch_limit)

    def batch_pages(self, pages: DataFrame) -> DataFrame:
        """The pages of this cycle's address batch; no address, no work."""
        return small(self.batch_urls(pages.sparkSession)).join(pages, "url").select(*pages.columns)

    def fetched(self, pages: DataFrame) -> DataFrame | None:
        """All attempts with ``status``, ``error_kind`` and ``error``; None when a hook ends the batch."""
        pages = applied(self.hooks.before_fetch, pages)
        if pages is None:
            return None
        if self.hooks.override_fetch is not None:
            problem = "override_fetch returned nothing"
            try:
                given = self.hooks.override_fetch(pages)
            except Exception as error:
                log.exception("override_fetch failed; so did every attempt")
                given, problem = None, f"override_fetch failed: {error}"
            pages = pages.withColumns({"status": F.lit(None).cast("int"), "error": F.lit(problem)}) if given is None else given
        if "status" not in pages.columns:
            pages = pages.withColumn("status", F.lit(200))
        if "error" not in pages.columns:
            pages = pages.withColumn("error", F.lit(None).cast("string"))
        pages = applied(self.hooks.after_fetch, pages)
        if pages is None:
            return None
        checked = guarded(pages.withColumnRenamed("error", "_failed"))
        kind = F.when(F.col("_failed").isNotNull(), "fetch").otherwise(F.col("error_kind"))
        return checked.withColumns({"error_kind": kind, "error": F.coalesce("_failed", "error")}).drop("_failed")

    def extracted(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(per-page rows with selector_matches, items that the keywords keep)."""
        if self.hooks.override_extract:
            try:
                items = self.hooks.override_extract(pages)
            except Exception:
                log.exception("override_extract failed; the batch has no items")
                items = None
            if items is None:
                items = pages.sparkSession.createDataFrame([], NO_ITEMS)
            items = items.withColumns({"job_id": F.lit(self.spec.job_id), "matches": F.array().cast("array<string>")})
            counts = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("selector_matches"))
            found = pages.select("page_id", "status").join(counts, "page_id", "left").fillna(0, ["selector_matches"])
            return found, items
        # Written once: both the page counts and the items come from it, and reading pages is the costly part.
        rows = durable(extract_pages(pages, self.spec))
        return rows.select("page_id", "status", "selector_matches"), items_of(rows, self.spec).drop("html")

    def kept(self, items: DataFrame) -> DataFrame | None:
        """The items to store, with their hashes; None when ``before_store`` stores nothing."""
        given = applied(self.hooks.after_extract, items)
        items = items.limit(0) if given is None else given
        try:
            given = filtered(items, self.spec, self.hooks.filter_item)
        except Exception:
            log.exception("filter_item failed; its input is kept, with its keywords read again")
            given = filtered(items, self.spec, F.lit(True))
        items = applied(self.hooks.before_store, items.limit(0) if given is None else given)
        return None if items is None else hash_items(items, self.spec)

    def pushed(self, attempts: DataFrame, items: DataFrame, batch_id: int) -> tuple[int, int]:
        """Urls that the ``push`` hook adds to the work, and its pushes of urls already known."""
        try:
            given = None if self.hooks.push is None else self.hooks.push(items)
        except Exception:
            log.exception("push failed; nothing is pushed")
            given = None
        if given is None:
            return 0, 0
        seen = durable(admitted(given, attempts))
        write_outbox(seen.where("fresh").select("url"), self.store.folder, "pushed", batch_id)
        return tuple(push_counts(seen).first())

    def run(self, pages: DataFrame, batch_id: int, ts_ns: Column | None = None) -> DataFrame | None:
        """Run one batch; returns its counts and diagnosis, or None when a hook failed and took the error.

        The counts are those of the items (``selector_matches``, ``kept``, ``new``, ``notified``), those of the attempts
        (``processed``, ``failed``, ``pushed``, ``duplicates``, and in ``outcomes`` how many ended how, which together are the
        processed ones), and the measured ``stages`` with ``total_ms``. Pages
        that failed, are too large or not UTF-8 are no items but rows of the ``rejected`` outbox.
        """
        try:
            counts = self._run(pages, batch_id, ts_ns)
            if self.hooks.on_success:
                self.hooks.on_success(counts)
            return counts
        except Exception as error:
            if self.hooks.on_error is None:
                raise
            self.hooks.on_error(error)
            return None
        finally:
            if self.hooks.on_finally:
                self.hooks.on_finally()

    def _run(self, pages: DataFrame, batch_id: int, ts_ns: Column | None) -> DataFrame:
        spark, stages, began = pages.sparkSession, [], time.perf_counter()
        pushes = (0, 0)

        def measured(stage: str, since: float) -> float:
            now = time.perf_counter()
            stages.append((stage, "success", 1000 * (now - since)))
            return now

        def result(found: DataFrame | None, kept: DataFrame | None, new: DataFrame | None, told: DataFrame | None, processed: int, failed: int) -> DataFrame:
            none = spark.createDataFrame([], "job_id string, selector_matches bigint, status int")
            job, rows = F.lit(self.spec.job_id), [r if r is not None else none for r in (kept, new, told)]
            counts = funnel(none if found is None else found.withColumn("job_id", job), *rows, ["job_id"])
            if found is None or not processed - failed:  # a batch without pages has a line as well
                counts = spark.range(1).select(job.alias("job_id")).join(counts, "job_id", "left").fillna(0, ["selector_matches", "kept", "new", "notified"])
            numbers = {"processed": processed, "failed": failed, "pushed": pushes[0], "duplicates": pushes[1]}
            ended = dict(attempts.where("error_kind IS NOT NULL").groupBy("error_kind").count().collect()) if failed else {}
            if found is not None:  # one row per outcome, of which there are few
                empty = spark.createDataFrame([], "page_id bigint")
                ended |= dict(page_outcomes(found, *[empty if r is None else r for r in (kept, new)], []).collect())
            timed = F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("status"), F.lit(c).alias("duration_ms")) for a, b, c in stages])
            return counts.withColumns(
                {**{name: F.lit(n).cast("bigint") for name, n in numbers.items()}, "diagnosis": diagnosis(), "outcomes": ended_as(ended), "stages": timed.cast(MEASURED), "total_ms": F.lit(1000 * (time.perf_counter() - began))}
            )

        attempts = self.fetched(pages)
        if attempts is None:
            return result(None, None, None, None, 0, 0)
        processed, failed = attempts.agg(F.count(F.lit(1)), F.count("error_kind")).first()
        since = measured("fetch", began)
        if failed:
            write_outbox(attempts.where(F.col("error_kind").isNotNull()).drop("html"), self.store.folder, "rejected", batch_id)
        found, items = self.extracted(attempts.where(F.col("error_kind").isNull()).drop("error_kind", "error"))
        pushes = self.pushed(attempts, items, batch_id)
        since = measured("extract", since)
        kept = self.kept(items)
        if kept is None:
            return result(found, None, None, None, processed, failed)
        kept = durable(kept)
        since = measured("filter", since)
        stamp = F.lit(self.store.stamp(batch_id)) if ts_ns is None else ts_ns
        new = self.store.add(kept, batch_id, stamp, self.scope).withColumns(
            {"job_name": F.lit(self.spec.name), "matches": F.col("match_key")}
        )
        since = measured("store", since)
        if self.spec.debug:
            bodies = attempts.where(F.col("error_kind").isNull()).select("page_id", "url", "html") if "html" in attempts.columns else None
            write_debug(kept, self.store.folder, batch_id, bodies)
        if new.isEmpty():  # nobody is told of nothing
            return result(found, kept, new, None, processed, failed)
        order = ["ts_ns", "page_id", "ord"]
        told = applied(self.hooks.before_notify, new)
        if self.spec.notification is not None and told is not None:
            texts = digests(told, order, self.spec.field_names, self.spec.notification, F.lit(self.spec.url), stamp)
            write_outbox(texts, self.store.folder, "notifications", batch_id)
            since = measured("notify", since)
        if self.spec.webhook is not None and self.spec.webhook.get("enabled", True):
            payloads = applied(self.hooks.before_webhook, webhook_payloads(new, order))
            if payloads is not None:
                write_outbox(payloads, self.store.folder, "webhooks", batch_id)
                measured("webhook", since)
        return result(found, kept, new, told, processed, failed)
