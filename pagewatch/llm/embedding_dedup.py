"""Near copies of vectors: random-hyperplane signs in several tables, exact cosine, and components.

Vectors with the same components are one class. In each table a vector's bucket is the signs of its products with some
random directions. Within a bucket all pairs are compared exactly, block against block, and what leaves a task is a
count of links per vector and a forest that joins linked vectors, never the pairs. A pair that meets in several tables
is counted in the first one only, which either vector's buckets tell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import by_group, components, joining
from pagewatch.session import durable

#: Share of pairs at the threshold that may be missed, classes that a bucket is meant to hold, and vectors of a block.
MISSED, BUCKET, BLOCK = 1e-4, 256, 1024


def plan(classes: int, threshold: float, missed: float = MISSED, bucket: int = BUCKET) -> tuple[int, int]:
    """Signs per table, which grow with the logarithm of the input, and tables, so that at most ``missed`` are missed."""
    signs = min(30, max(4, math.ceil(math.log2(max(2, classes) / bucket))))
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(missed) / math.log1p(-meet))


def sign_hashes(x: np.ndarray, signs: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of every vector in every table. Directions depend on the seed and the length of the vectors alone."""
    directions = np.random.default_rng(seed).normal(size=(x.shape[1], tables * signs))
    bits = (x @ directions > 0).reshape(len(x), tables, signs)
    return (bits * (1 << np.arange(signs))).sum(axis=2).astype(np.int32)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashed(classes: DataFrame, signs: int, tables: int, seed: int, kind: str) -> DataFrame:
    """(v, members, size, vector, keys, buckets): vectors and buckets as bytes, and the buckets as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            raw = batch.column("embedding").to_pylist()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.array([raw[i] for i in at], kind)
                keys = sign_hashes(units(x.astype(np.float64)), signs, tables, seed)
                part = batch.take(pa.array(at))
                short = keys.astype(np.uint16 if signs <= 16 else np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("v"), part.column("members"), part.column("size"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in short], pa.binary()), lists],
                    ["v", "members", "size", "vector", "keys", "buckets"],
                )

    return classes.mapInArrow(run, "v long, members long, size int, vector binary, keys binary, buckets array<int>")


def compared(rows: pa.Table, threshold: float, tables: int, kind: str) -> pa.RecordBatch:
    """(v, to, n) of two blocks of one bucket, or of one block with itself: every vector's links, weighted with the members
    of the classes at their other ends, and links that join what the blocks join."""
    table, size, many = rows["table"][0].as_py(), rows["size"][0].as_py(), len(rows)
    x = units(np.frombuffer(b"".join(rows["vector"].to_pylist()), kind).reshape(many, size).astype(np.float64))
    packed = b"".join(rows["keys"].to_pylist())
    keys = np.frombuffer(packed, f"u{len(packed) // (many * tables)}").reshape(many, tables)[:, :table]
    v, members, side = (rows[c].to_numpy() for c in ("v", "members", "side"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not rows["crossed"][0].as_py()
    near = x[left] @ x[left if alone else right].T >= threshold
    a, b = np.nonzero(np.triu(near, 1) if alone else near)
    a, b = left[a], (left if alone else right)[b]
    if table and len(a):
        a, b = (c[~np.concatenate([(keys[a[k : k + 100_000]] == keys[b[k : k + 100_000]]).any(axis=1) for k in range(0, len(a), 100_000)])] for c in (a, b))
    counts = np.zeros(many, np.int64)
    np.add.at(counts, a, members[b])
    np.add.at(counts, b, members[a])
    keep = joining(list(range(many)), a.tolist(), b.tolist())
    touched = np.flatnonzero(counts)
    # A link of the forest has no count of its own, a count links its vector with itself.
    ends = [np.concatenate([v[touched], v[a[keep]]]), np.concatenate([v[touched], v[b[keep]]]), np.concatenate([counts[touched], np.zeros(len(keep), np.int64)])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in ends], ["v", "to", "n"])


GROUP = ["size", "table", "bucket", "i", "j"]


def near_copies(df: DataFrame, threshold: float = 0.9, seed: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``, links being pairs of cosine ``threshold`` or more.

    Vectors that are null, empty or zero, or hold null or infinite components or none that is a number, link with
    nothing, and so do vectors of different lengths. Rows of one id and vector are one vector, so ``n_links`` counts
    other ids; rows of one id with different vectors link as what they are and share a component. A row without id is
    compared with nothing and kept. Other columns are not read, labels neither.
    """
    vector = F.col(vector_column).cast("array<double>")
    sound = F.expr("size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(e, x -> x <> 0)")
    rows = df.select(F.col(id_column).cast("long").alias("id"), vector.alias("e"))
    # -0.0 and 0.0 are one component.
    good = rows.where("id IS NOT NULL").where(sound).select("id", F.transform("e", lambda x: x + F.lit(0.0)).alias("e")).withColumn("key", F.sha2(F.to_json(F.struct("e")), 256))
    distinct = good.select("id", "key", "e").dropDuplicates(["id", "key"])
    classes = durable(distinct.groupBy("key").agg(F.min("id").alias("v"), F.count("*").alias("members"), F.first("e").alias("embedding")))
    signs, tables = plan(classes.count(), threshold, bucket=bucket)
    kind = "f4" if "float" in dict(df.dtypes)[vector_column] else "f8"
    placed = durable(hashed(classes.select("v", "members", F.size("embedding").alias("size"), "embedding"), signs, tables, seed, kind))
    each = placed.select("v", "members", "size", "vector", "keys", F.posexplode("buckets").alias("table", "bucket"))
    full = each.groupBy("size", "table", "bucket").agg(F.count("*").alias("held")).where("held > 1").withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
    member = each.join(full, ["size", "table", "bucket"]).withColumn("own", F.pmod(F.xxhash64("v", "table"), F.col("blocks")).cast("int"))
    # Every pair of blocks of a bucket is a group of its own, so no group has more than about two blocks of rows.
    paired = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "v", "members", "vector", "keys", "size", "table", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("crossed")
    )
    grouped = paired.repartition(*[F.col(c) for c in GROUP]).sortWithinPartitions(*GROUP)
    found = durable(grouped.mapInArrow(by_group(GROUP, lambda rows: compared(rows, threshold, tables, kind)), "v long, to long, n long"))
    linked = found.groupBy("v").agg(F.sum("n").alias("n"))
    same = distinct.join(classes.select("key", "v", "members"), "key").select("id", "v", "members")
    per_id = same.join(linked, "v", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    links = found.where("v <> to").select(F.col("v").alias("a"), F.col("to").alias("b")).union(same.where("id <> v").select(F.col("id").alias("a"), F.col("v").alias("b")))
    reached = components(links).select(F.col("v").alias("id"), F.col("component").alias("component_id"))
    answer = rows.select("id").join(per_id, "id", "left").join(reached, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return answer.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
