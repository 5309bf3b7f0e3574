"""Change signals: price drops, failure streaks, the circuit breaker, heartbeats, and what a run amounted to."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions.text import duration_text
from pagewatch.operators.folding import keyed_fold
from pagewatch.operators.ordered import GROUP_ROWS, largest_group, running

# The minimum price before any was seen, and the words of a sale.
NO_MINIMUM, SALE_WORDS = 999999.0, ["SALE", "OFF"]

# The stages of a cycle in order, with their kind.
STAGES = [
    ("before_fetch", "hook"),
    ("override_fetch", "hook"),
    ("fetch", "internal"),
    ("after_fetch", "hook"),
    ("override_extract", "hook"),
    ("extract", "internal"),
    ("after_extract", "hook"),
    ("filter", "internal"),
    ("before_store", "hook"),
    ("store", "internal"),
    ("before_notify", "hook"),
    ("notify", "internal"),
    ("before_webhook", "hook"),
    ("webhook", "internal"),
]

DAY = 24 * 60 * 60


def price_alerts(
    items: DataFrame,
    key: str,
    order: list[str],
    price: Column,
    title: Column | None = None,
    minima: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``prior_min`` and ``alert``: a price below the lowest seen so far, else a title that names a sale.

    ``minima(key, min_price)`` carries the lowest prices of earlier runs.
    """
    priced = items.withColumn("_price", F.coalesce(price, F.lit(0.0)).cast("double"))
    counted = F.when(F.col("_price") > 0, F.col("_price"))
    seen = running(priced, [key], order, {"_seen": ("min", counted)}, through=False, group_rows=group_rows)
    known = F.lit(NO_MINIMUM)
    if minima is not None:
        seen = seen.join(minima.select(key, F.col("min_price").alias("_known")), key, "left")
        known = F.least(F.col("_known"), known)
    prior = F.least(F.col("_seen"), known)
    dropped = (F.col("_price") > 0) & (F.col("_price") < prior)
    alert = F.when(dropped, "price_drop")
    if title is not None:
        on_sale = reduce(lambda a, b: a | b, [F.contains(F.upper(title), F.lit(word)) for word in SALE_WORDS])
        alert = alert.when(on_sale, "sale")
    return seen.withColumns({"prior_min": prior, "alert": alert}).drop("_seen", "_known", "_price")


def lowest_prices(items: DataFrame, key: str, price: Column, minima: DataFrame | None = None) -> DataFrame:
    """The minimum per key after ``items``; a price at or above the starting value never becomes one."""
    valid = items.select(key, price.cast("double").alias("min_price")).where((F.col("min_price") > 0) & (F.col("min_price") < NO_MINIMUM))
    both = valid if minima is None else valid.unionByName(minima.select(key, "min_price"))
    return both.groupBy(key).agg(F.min("min_price").alias("min_price"))


def failure_streaks(attempts: DataFrame, key: str, order: list[str], failed: Column, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``streak``: failures since the last success of the key, 0 on a success."""
    sizes = largest_group(attempts, [key])
    counted = running(
        attempts.withColumn("_failed", failed), [key], order, {"_failures": ("sum", F.col("_failed").cast("bigint"))},
        group_rows=group_rows, sizes=sizes,
    )
    at_success = F.when(~F.col("_failed"), F.col("_failures"))
    based = running(counted, [key], order, {"_base": ("max", at_success)}, group_rows=group_rows, sizes=sizes)
    return based.withColumn("streak", F.col("_failures") - F.coalesce("_base", F.lit(0))).drop("_failed", "_failures", "_base")


@dataclass(frozen=True)
class BreakerRules:
    alert_at: int = 30
    stop_at: int = 50
    cooldown: int = DAY

    def step(self, state: tuple[float, float], attempt: tuple) -> tuple[tuple[float, float], tuple[str, str]]:
        """(failures, stop time) and (time, status, failed, selector matches) to the next state and (action, alerts)."""
        failures, stopped = state
        time, status, failed, matches = attempt
        action = "fetched"
        if failures >= self.stop_at:
            if time - stopped < self.cooldown:
                return state, ("skipped", "")
            action, stopped = "probe", time
        if failed or status != 200:
            return self._failure(failures, stopped, time, status, action)
        alerts = ["recovered"] if failures >= self.alert_at else []
        failures, stopped = 0.0, 0.0
        if matches == 0:
            alerts.append("layout")
            failures, stopped = float(self.stop_at), time
        return (failures, stopped), (action, ",".join(alerts))

    def _failure(self, failures, stopped, time, status, action):
        if status == 403:
            return (float(self.stop_at), time), (action, "banned")
        if status == 404:
            return (failures, stopped), (action, "missing")
        failures += 1
        if failures == self.alert_at:
            return (failures, stopped), (action, "failing")
        if failures == self.stop_at:
            return (failures, time), (action, "stopped")
        return (failures, stopped), (action, "")


BREAKER_STATE = ["fail_count", "stop_time"]


def circuit_breaker(
    attempts: DataFrame, key: str, order: list[str], rules: BreakerRules | None = None, known: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``attempts(key, time, status, failed, selector_matches)`` with action, alerts and the state after each."""
    rules = rules or BreakerRules()
    inputs = ["time", "status", "failed", "selector_matches"]
    return keyed_fold(
        attempts, key, order, inputs, (0.0, 0.0), rules.step, "action string, alerts string", known, BREAKER_STATE, group_rows
    )


def heartbeats(
    ticks: DataFrame, key: str, order: list[str], time: str, every: int = DAY, known: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``beat``: true when at least ``every`` seconds have passed since the last beat of the key."""

    def step(state: tuple, row: tuple) -> tuple:
        now = float(row[0])
        return ((now,), (True,)) if now - state[0] >= every else (state, (False,))

    return keyed_fold(ticks, key, order, [time], (0.0,), step, "beat boolean", known, ["last_beat"], group_rows)


def last_state(outcomes: DataFrame, key: str, order: list[str], columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """The state of every key after its last row; keys without a row keep the state they had."""
    latest = outcomes.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("_last"))
    state = latest.select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])
    return state if known is None else state.unionByName(known.select(key, *columns).join(state, key, "left_anti"))


def funnel(pages: DataFrame, kept: DataFrame, new: DataFrame, notified: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: selector matches, items kept, new items and items notified."""
    counts = pages.groupBy(*keys).agg(
        F.sum("selector_matches").cast("bigint").alias("selector_matches"), F.min("status").alias("status")
    )
    for name, rows in (("kept", kept), ("new", new), ("notified", notified)):
        counts = counts.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    return counts.fillna(0, ["kept", "new", "notified"])


def diagnosis() -> Column:
    """What a funnel row says about the run; only pages answered with 200 are judged."""
    return (
        F.when(F.col("status") >= 400, "http_error")
        .when(F.col("status") != 200, "ok")
        .when((F.col("kept") == 0) & (F.col("selector_matches") == 0), "selector_matched_nothing")
        .when(F.col("kept") == 0, "no_keyword_hit")
        .when(F.col("new") == 0, "nothing_new")
        .otherwise("ok")
    )


def page_outcomes(pages: DataFrame, kept: DataFrame, new: DataFrame, keys: list[str], page: str = "page_id") -> DataFrame:
    """Per key and outcome how many pages ended so (``keys, outcome, pages``); every row of ``pages`` has one outcome.

    The outcome is the diagnosis of the page, so a page that failed is seen beside others that were answered. An attempt
    that has an ``error_kind`` ended with that and is not judged further.
    """
    counts = pages
    for name, rows in (("kept", kept), ("new", new)):
        found = rows.groupBy(*keys, page).agg(F.count(F.lit(1)).alias(name))
        counts = counts.join(found, [*keys, page], "left")
    failed = F.col("error_kind") if "error_kind" in pages.columns else F.lit(None).cast("string")
    outcome = F.coalesce(failed, diagnosis()).alias("outcome")
    return counts.fillna(0, ["kept", "new"]).groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("pages"))


def cycle_stats(attempts: DataFrame, failed: Column, keys: list[str] | None = None) -> DataFrame:
    return attempts.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(failed).alias("failed"),
    )


def stage_summary(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Every stage of every run: its status (inactive when not measured), duration, and whether it was slow.

    ``measured(keys, stage, status, duration_ms, error)`` holds at most one row per run and stage.
    """
    stages = F.array(*[
        F.struct(F.lit(at).alias("stage_no"), F.lit(name).alias("stage"), F.lit(kind).alias("kind"))
        for at, (name, kind) in enumerate(STAGES, 1)
    ])
    runs = measured.select(*keys).distinct().select(*keys, F.inline(stages))
    rows = runs.join(measured, [*keys, "stage"], "left")
    active = F.coalesce("status", F.lit("inactive"))
    millis = F.coalesce("duration_ms", F.lit(0.0))
    speed = F.when((active == "inactive") | (millis == 0), "none").when(millis > 5000, "very_slow").when(millis > 1000, "slow")
    return rows.select(
        *keys, "stage_no", "stage", "kind", active.alias("status"), millis.alias("duration_ms"),
        duration_text(millis).alias("duration"), speed.otherwise("normal").alias("speed"), "error",
    )
