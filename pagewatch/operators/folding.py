"""Sequential state per key, worked in parallel along the order of a single key as well.

Some rules cannot be windows: whether a row changes the state depends on the state. Rows are range partitioned by
(key, order) into pieces; a piece that starts in the middle of a key needs the state the earlier piece ends with. The
pieces guess the empty state first, and only those that guessed wrong and pass the difference on are run again, until
nothing changes. A state that is often reset (by a success, say) settles in one or two rounds, and the answer is exact
in any case. What reaches the driver is one state per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from pagewatch.operators.ordered import CHUNK, GROUP_ROWS, chunked

State = tuple[float, ...]
# (state, row values) -> (next state, output values)
Transition = Callable[[State, tuple], tuple[State, tuple]]


def keyed_fold(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    inputs: Sequence[str],
    empty: State,
    step: Transition,
    outputs: str,
    known: DataFrame | None = None,
    state_columns: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows with the ``outputs`` of ``step`` and the state after each row (``state_columns``).

    ``inputs`` are the columns handed to ``step``. ``known`` holds the state of keys from earlier runs.
    """
    columns = list(dict.fromkeys([key, *order, *inputs]))
    start_columns = [f"_start_{name}" for name in state_columns]
    source = rows.select(*columns)
    if known is None:
        source = source.withColumns({name: F.lit(value).cast("double") for name, value in zip(start_columns, empty)})
    else:
        started = known.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(s) for c, s in zip(state_columns, start_columns)])
        source = source.join(started, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").fillna(dict(zip(start_columns, empty)))
    total = source.count()
    pieces = max(-(-total // group_rows), rows.sparkSession.sparkContext.defaultParallelism)
    chunks = chunked(source, [key], order, max(1, -(-total // pieces)), max(1, total))

    # Inside a struct NULL is a key like any other, and the first in order.
    wrapped = F.struct(key)
    ends = chunks.groupBy(CHUNK).agg(F.min(wrapped).alias("low"), F.max(wrapped).alias("high")).collect()
    spans = {r[CHUNK]: (r["low"][0], r["high"][0]) for r in ends}
    order_of = sorted(spans)
    follows = {b: a for a, b in zip(order_of, order_of[1:]) if spans[a][1] == spans[b][0]}
    entering = _settle(chunks, key, inputs, start_columns, step, spans, follows)

    schema = T.StructType([f for f in source.schema.fields if f.name in columns])
    for part in T.StructType.fromDDL(outputs).fields:
        schema = schema.add(part)
    for name in state_columns:
        schema = schema.add(name, T.DoubleType())
    fold = _folder(key, inputs, start_columns, step, entering)
    out_names = T.StructType.fromDDL(outputs).fieldNames()

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, states, results in fold(batches):
            made = pd.DataFrame(results, columns=out_names, index=batch.index)
            after = pd.DataFrame(states, columns=list(state_columns), index=batch.index, dtype="float64")
            yield pd.concat([batch[columns], made, after], axis=1)

    return chunks.mapInPandas(emit, schema)


def _plain(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist()


def _folder(key, inputs, start_columns, step, entering):
    def fold(batches):
        current, piece, state = None, None, ()
        for batch in batches:
            states, results = [], []
            keys, chunk_of = _plain(batch[key]), batch[CHUNK].tolist()
            starts = list(zip(*[batch[c].tolist() for c in start_columns]))
            values = list(zip(*[_plain(batch[c]) for c in inputs]))
            for name, chunk, begin, row in zip(keys, chunk_of, starts, values):
                if chunk != piece:
                    piece, current = chunk, name
                    state = entering.get(chunk, begin)
                elif name != current:
                    current, state = name, begin
                state, result = step(state, row)
                states.append(state)
                results.append(result)
            yield batch, states, results

    return fold


def _settle(chunks, key, inputs, start_columns, step, spans, follows):
    """The state each piece is entered with, for pieces that continue a key."""
    feeding = set(follows.values())
    if not feeding:
        return {}
    # The last key of every feeding piece: one row per piece, so a broadcast is safe.
    schema = T.StructType([chunks.schema[CHUNK], chunks.schema[key]])
    ending = chunks.sparkSession.createDataFrame([(c, spans[c][1]) for c in sorted(feeding)], schema)
    same = (F.col(f"c.{CHUNK}") == F.col(f"e.{CHUNK}")) & F.col(f"c.{key}").eqNullSafe(F.col(f"e.{key}"))
    last_rows = chunks.alias("c").join(F.broadcast(ending).alias("e"), same, "left_semi")
    leaving: dict[int, State] = {}
    entering: dict[int, State] = {}
    todo = feeding
    while todo:
        fold = _folder(key, inputs, start_columns, step, dict(entering))

        def ends(batches):
            last = {}
            for batch, states, _ in fold(batches):
                last.update(zip(batch[CHUNK].tolist(), states))
            yield pd.DataFrame([(chunk, *state) for chunk, state in last.items()], columns=["piece", *start_columns])

        schema = "piece int, " + ", ".join(f"{c} double" for c in start_columns)
        for row in last_rows.where(F.col(CHUNK).isin(list(todo))).mapInPandas(ends, schema).collect():
            leaving[row[0]] = tuple(row[1:])
        todo = set()
        for piece, before in follows.items():
            if entering.get(piece) != leaving[before]:
                entering[piece] = leaving[before]
                # Only a piece that lies wholly inside one key hands the difference on.
                if piece in feeding and spans[piece][0] == spans[piece][1]:
                    todo.add(piece)
    return entering
