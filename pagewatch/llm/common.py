"""What several operators of this subpackage share: record batches by size, byte words, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.session import durable, give_back

#: Text that one step of a task works on at a time, and words that a task remembers.
BATCH_BYTES = 4 << 20
MEMO_WORDS = 100_000
#: Links that one task joins to components; more are joined in rounds of joins.
FEW_LINKS = 100_000
#: Rows that Spark hands to a Python worker at a time; its own default, 10,000, is meant for short rows.
BATCH_ROWS = 1024


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts takes, in the session of the caller."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 on division by 4. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def released(run):
    """``run``, with the memory kept for later given back at the end of a task: a worker that then waits idle
    beside other stages takes room that those need."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` has about ``limit`` bytes; one longer row is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in batches whose ``column`` has about ``limit`` bytes, small batches put together."""
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, column, limit):
            more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
            if held and size + more > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch)
            size += more
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which near inputs become unlike outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def by_group(columns: list[str], work):
    """``work`` on every group of rows with equal ``columns``, which sorting has put together, across the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if last is not None and tuple(names[start]) != last:
                    yield work(pa.Table.from_batches(held))
                    held = []
                last = tuple(names[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def joining(labels: list[int], a: list[int], b: list[int]) -> list[int]:
    """Which of the links between places ``a`` and ``b`` join two parts that were apart, places of one label being together."""
    root = {k: k for k in set(labels)}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    kept = []
    for n, (i, j) in enumerate(zip(a, b)):
        i, j = find(labels[i]), find(labels[j])
        if i != j:
            root[max(i, j)] = min(i, j)
            kept.append(n)
    return kept


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each batch as links of its vertices to the smallest vertex that the batch joins them with."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := root.setdefault(v, v)) != v:
                root[v] = root[up]
                v = up
            return v

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        linked = [v for v in list(root) if find(v) != v]
        yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array([find(v) for v in linked], pa.int64())], ["a", "b"])


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a task as one batch of ``forests``."""
    held = list(batches)
    if held:
        yield from forests(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(v, component) for every vertex of ``links`` (a, b): the smallest vertex that it reaches, itself included.

    Each round hangs a vertex's larger neighbours, then its smaller ones, below its smallest neighbour, until every
    vertex hangs below the smallest of its component. Minima are combined before the shuffle and joined back, so a
    vertex with very many links is an ordinary skewed join. Self links keep lone vertices. At most ``few`` links are
    joined in one step, since rounds write many small files.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = durable(ends.where("a <> b").mapInArrow(forests, "a long, b long").distinct())
    before, many = None, edges.count()
    if many <= few:
        edges = durable(edges.coalesce(1).mapInArrow(released(forest), "a long, b long"))
    while many > few:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "n")
        least = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        wide = both.where("n > u").join(least, "u").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        down = wide.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(down.union(least.select("a", F.col("m").alias("b"))).distinct())
    roots = ends.select("a").union(ends.select("b")).distinct()
    return roots.join(edges, "a", "left").select(F.col("a").alias("v"), F.coalesce("b", "a").alias("component"))
