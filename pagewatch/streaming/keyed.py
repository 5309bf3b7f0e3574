"""Keyed state over micro-batches: circuit breaker, lowest prices and heartbeats.

The state of all keys is a small table per micro-batch. A batch reads the table of the batch before it and writes its
own, so repeating a batch repeats the same step. Within a batch the skew-safe batch operators do the work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagewatch.operators import signals
from pagewatch.session import durable


@dataclass(frozen=True)
class KeyedTables:
    """``<folder>/state/batch_id=N`` and ``<folder>/outcomes/batch_id=N``."""

    folder: str
    state_schema: str

    def state(self, spark: SparkSession, after_batch: int) -> DataFrame:
        """State after a batch; before the first one it is empty."""
        if after_batch < 0:
            return spark.createDataFrame([], self.state_schema)
        return spark.read.schema(self.state_schema).parquet(f"{self.folder}/state/batch_id={after_batch}")

    def write(self, outcomes: DataFrame, state: DataFrame, batch_id: int) -> None:
        outcomes.write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch_id={batch_id}")
        state.write.mode("overwrite").parquet(f"{self.folder}/state/batch_id={batch_id}")

    def outcomes(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.folder}/outcomes")
        except AnalysisException:
            return None


Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def keyed_stream(rows: DataFrame, tables: KeyedTables, step: Step, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``step(batch, state) -> (outcomes, next state)`` over the stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        known = tables.state(batch.sparkSession, batch_id - 1)
        outcomes, state = step(batch, known)
        tables.write(outcomes, state, batch_id)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def breaker_step(key: str, order: list[str], rules: signals.BreakerRules) -> Step:
    def step(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        outcomes = durable(signals.circuit_breaker(batch, key, order, rules, known))
        return outcomes, signals.last_state(outcomes, key, order, signals.BREAKER_STATE, known)

    return step


def minima_step(key: str, order: list[str], price: Column, title: Column | None = None) -> Step:
    def step(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        return signals.price_alerts(batch, key, order, price, title, known), signals.lowest_prices(batch, key, price, known)

    return step


def heartbeat_step(key: str, order: list[str], time: str, every: int = signals.DAY) -> Step:
    def step(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        outcomes = durable(signals.heartbeats(batch, key, order, time, every, known))
        return outcomes, signals.last_state(outcomes, key, order, ["last_beat"], known)

    return step
