"""How filters of a chain interact: what each removes at every step of every order of the chain.

A document is the mask of the filters that it fails. Each mask stands for one wide integer whose fields hold the outcomes
of all steps of all orders; these integers, times the documents of the mask, are added up per part of the corpus, and
the fields of the sum are the counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import slices
from pagewatch.session import durable

FILTERS = "ABCDE"
#: Bits of a field. A field of a sum is at most the rows of its part, which Spark counts in a signed 64-bit number.
FIELD = 64
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
CONTINUATIONS = bytes(range(0x80, 0xC0))
PARTS_AT_A_TIME = 64


def failing(text: bytes) -> int:
    """Bits 0 to 3 for the filters A to D that a text fails."""
    words = text.split()
    points = len(text.translate(None, CONTINUATIONS))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2 | (MARKS.search(text) is not None) << 3


@lru_cache
def steps(letters: str) -> tuple[list[str], np.ndarray]:
    """The orders in the order of the alphabet, and the number of the filter at each of their steps."""
    orders = ["".join(p) for p in permutations(sorted(letters))]
    return orders, np.array([[letters.index(x) for x in order] for order in orders])


@lru_cache
def packed(letters: str) -> list[int]:
    """For every mask, the integer of its outcomes: fields of step 1 of the first order first, ``OUTCOMES`` in each."""
    _, at = steps(letters)
    wide = []
    for mask in range(1 << len(letters)):
        fails = (mask >> at) & 1
        before = np.cumsum(fails, axis=1) - fails
        fields = np.stack([(before + fails) == 0, (fails == 1) & (before == 0), (fails == 1) & (before > 0), mask == 1 << at], axis=2)
        wide.append(int.from_bytes(fields.astype(f"<u{FIELD // 8}").tobytes(), "little"))
    return wide


def unpacked(total: int, letters: str) -> np.ndarray:
    """The fields of a sum of packed masks: [step of all orders, outcome]."""
    size = steps(letters)[1].size * len(OUTCOMES)
    return np.frombuffer(total.to_bytes(size * FIELD // 8, "little"), f"<i{FIELD // 8}").reshape(-1, len(OUTCOMES))


def masks(df: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """(id, part, mask) per row: bit k is set if filter k of ``FILTERS`` fails. E, sameness with a smaller id's text, is
    told by the 128-bit digest of the text, so each text is read once and only digests move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [text or b"" for text in batch.column("text").to_pylist()]
                digests = [hashlib.blake2b(text, digest_size=16).digest() for text in texts]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array([failing(t) for t in texts], pa.int32())], ["id", "part", "content", "mask"])

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col(text_column).cast("string").cast("binary").alias("text"))
    rows = durable(rows.mapInArrow(run, "id long, part string, content binary, mask int"))
    first = durable(rows.groupBy("content").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(first, "content", "left").select("id", "part", F.col("mask").bitwiseOR(F.shiftleft(late, 4)).alias("mask"))


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The audit of ``counts`` (part, mask, n, good, toxic): a row per part, order of ``letters`` and step.

    Any filters will do whose failures are bits of ``mask`` in the order of ``letters``. A part has at most
    ``2 ** len(letters)`` masks, so no part outgrows a task however many documents it has.
    """
    orders, at = steps(letters)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def table(parts: list[str], sums: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        fields = [np.concatenate([s[k] for s in sums]) for k in range(7)]
        names = pa.array(np.repeat(np.array(parts, dtype=object), at.size), pa.string())
        order = pa.array(np.tile(np.repeat(np.array(orders, dtype=object), len(letters)), len(parts)), pa.string())
        step = pa.array(np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders) * len(parts)))
        return pa.RecordBatch.from_arrays([names, order, step, *map(pa.array, fields)], [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = packed(letters)
        for whole in batches:
            for start in range(0, whole.num_rows, PARTS_AT_A_TIME):
                batch, sums = whole.slice(start, PARTS_AT_A_TIME), []
                for held in batch.column("held").to_pylist():
                    every, good, toxic = (unpacked(sum(wide[m["mask"]] * m[k] for m in held), letters) for k in ("n", "good", "toxic"))
                    shapley = np.zeros(len(letters), np.int64)
                    np.add.at(shapley, at.reshape(-1), every[:, 1])
                    sums.append((*every.T, good[:, 1], toxic[:, 1], shapley[at.reshape(-1)]))
                yield table(batch.column("part").to_pylist(), sums)

    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    return held.mapInArrow(run, schema)


def audit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """The five filters ``FILTERS`` on the rows of ``df``, by ``part_column``, with what good and toxic rows are lost.

    A null or empty text fails A alone (and E, if a smaller id has one too). Words are what stands between ASCII white
    space, texts of any length are read whole. E compares ids: repeated rows of one id do not make each other late, and
    a row without id neither is late nor makes others late. A null part and an empty one are the same part. A document
    is good or toxic if any row of its id in ``labels`` says so; rows of ``labels`` without id mark nothing. Without rows
    there are no parts. Other columns are not read.

    Hot texts and parts cost no more than others: minima and counts are combined before the shuffle, and the joins
    back are ordinary skewed joins, which adaptive execution splits, since their other sides are checkpointed.
    """
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("marked"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    rows = masks(df, id_column, text_column, part_column)
    rows = rows.join(durable(marks), F.col("id") == F.col("marked"), "left")
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(k, F.lit(0))).cast("long").alias(k) for k in ("good", "toxic")])
    return interactions(counted)
