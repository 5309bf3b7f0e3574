"""Near copies of documents by SuperMinHash signatures, banding, verification on full sets, and components.

Every shingle draws one value per step and one slot of a permutation of its own, so that the values of a slot come from
growing intervals; a document stops as soon as all its slots are filled, which long documents reach after a step or two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.llm.common import by_group, components, joining, mix, released, slices, WordHashes
from pagewatch.session import durable, small

#: Bands and rows: a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 26, 3 in 100,000.
BANDS, ROWS = 26, 5
STEP_ELEMENTS = 20_000
#: Rows of a block that meets another one in a task, and shingles of one product.
BLOCK, COLUMNS = 256, 4096
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles as sorted 64-bit hashes; fewer words are one shingle, none are none."""
    n = len(hashes)
    if not n:
        return hashes
    wide = min(n, width)
    total = np.full(n - wide + 1, wide, np.uint64)
    for k in range(wide):
        total = mix(total * FACTORS[k % len(FACTORS)] + hashes[k : n - wide + 1 + k])
    return np.unique(total)


def text_sets(texts: list[bytes | None], memo: WordHashes, width: int) -> list[np.ndarray]:
    """Shingle sets of texts: A-Z lower-cased, words between ASCII white space."""
    return [shingle_set(memo.of(text.lower().split()), width) if text else np.empty(0, np.uint64) for text in texts]


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, one row of ``slots`` values per set: the step of the value in the high half, its fraction in the low."""
    signatures = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = signatures.reshape(-1)
    docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = None
    with np.errstate(over="ignore"):
        for step in range(slots):
            if not len(elements):
                break
            draw = mix(elements + np.uint64(step + 1) * FACTORS[0])
            value = (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32))
            at = step + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(slots - step)).astype(np.int64)
            if step == 0:
                first = slot = at
            else:
                if order is None:  # only what is still active needs its permutation written out
                    order = np.tile(np.arange(slots, dtype=np.int32), (len(elements), 1))
                    rows = np.arange(len(elements))
                    order[rows, first] = 0
                    order[rows, 0] = first
                rows = np.arange(len(elements))
                slot = order[rows, at].astype(np.int64)
                order[rows, at] = order[rows, step]
                order[rows, step] = slot
            np.minimum.at(flat, docs * slots + slot, value)
            open_docs = (signatures == np.iinfo(np.uint64).max).any(axis=1)
            active = open_docs[docs]
            if not active.all():
                docs, elements = docs[active], elements[active]
                if order is None:
                    first = first[active]
                else:
                    order = order[active]
    return signatures


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands))
        for k in range(rows):
            key = mix(key * FACTORS[1] + parts[:, :, k])
    return key.view(np.int64)


def fingerprints(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """The rows of ``df`` with n_shingles, set_key and bands in the place of ``text``."""
    others = [c for c in df.columns if c != "text"]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = text_sets(batch.column("text").to_pylist(), memo, width)
                keys = np.zeros((len(sets), bands), np.int64)
                start = 0
                while start < len(sets):  # so many rows that their permutations stay small
                    end, total = start, 0
                    while end < len(sets) and (end == start or total + len(sets[end]) <= STEP_ELEMENTS):
                        total += len(sets[end])
                        end += 1
                    keys[start:end] = band_keys(super_minhash(sets[start:end], bands * rows), bands, rows)
                    start = end
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), lists],
                    [*others, "n_shingles", "set_key", "bands"],
                )

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), "n_shingles long, set_key binary, bands array<long>"])
    return df.select(*others, F.col("text").cast("binary").alias("text")).mapInArrow(released(run), schema)


def whole_sets(df: DataFrame, width: int) -> DataFrame:
    """(v, shingles) for rows of ``df`` (v, text): the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = text_sets(batch.column("text").to_pylist(), memo, width)
                yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "shingles"])

    return df.select("v", F.col("text").cast("binary").alias("text")).mapInArrow(released(run), "v long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``100 * intersection >= percent * union``.

    A hub ``a`` is sent once to each block of its partners ``b``, in front of them, and kept while they pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            keep = []
            for a, b, shingles in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles")):
                other = np.frombuffer(shingles.as_buffer(), np.uint64)
                if b is None:
                    hub, own = a, other
                    keep.append(False)
                    continue
                assert a == hub, "a block begins with its hub"
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = durable(pairs.join(durable(blocks), "a").withColumn("part", F.pmod(F.xxhash64("b"), "blocks").cast("int")).drop("blocks"))
    partners = dealt.join(sets.select(F.col("v").alias("b"), "shingles"), "b").select("a", "part", "b", "shingles")
    hubs = dealt.select("a", "part").distinct().join(sets.select(F.col("v").alias("a"), "shingles"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    rows = partners.union(hubs).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return rows.select("a", "b", "shingles").mapInArrow(released(run), "a long, b long")


def block_links(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Links (a, b) that join different components in two blocks of one bucket, or in one block, by full sets.

    Intersections of all rows are the product of their incidences on the shingles that several rows have, so many
    columns at a time.
    """
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    v, c, side = (rows[name].to_numpy() for name in ("v", "c", "side"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not rows["crossed"][0].as_py():
        right = left
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        incidence = np.zeros((len(sets), COLUMNS), np.float32)
        incidence[owner[part], column[part] - start] = 1
        both += (incidence[left] @ incidence[right].T).astype(np.int64)  # exact: a product counts to COLUMNS at most
    near = (100 * both >= percent * (sizes[left][:, None] + sizes[right] - both)) & (c[left][:, None] != c[right])
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    keep = joining(c.tolist(), a.tolist(), b.tolist())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(v[a[keep]], v[b[keep]])), pa.array(np.maximum(v[a[keep]], v[b[keep]]))], ["a", "b"])


GROUP = ["bucket", "i", "j"]


def between_components(placed: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between components within the buckets of ``placed`` (bucket, v, c).

    Members outside a bucket's largest component meet all others. Both kinds are dealt out to blocks, and every pair of
    blocks of which one is outside is a group of its own.
    """
    # Two members have met each other already, and buckets of the same members are compared once.
    held = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")).where("n > 2")
    placed = placed.join(held.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")
    sizes = placed.groupBy("bucket", "c").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("c", "members").alias("main"), F.max("members").alias("inside"), (F.sum("members") - F.max("members")).alias("outside")).where("parts > 1")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    mixed = mixed.select("bucket", "main", blocks("outside").alias("o"), blocks("inside").alias("m"))
    dealt = placed.join(mixed, "bucket").withColumn("is_out", F.col("c") != F.col("main"))
    spread = F.xxhash64("v", "bucket")
    dealt = dealt.withColumn("own", F.when(F.col("is_out"), F.pmod(spread, "o")).otherwise(F.col("o") + F.pmod(spread, "m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_out"), F.col("o") + F.col("m")).otherwise(F.col("o")) - 1)))
    grid = dealt.select(
        "bucket", "v", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") != F.col("other")).alias("crossed")
    )
    rows = grid.join(sets, "v").repartition(*[F.col(x) for x in GROUP]).sortWithinPartitions(*GROUP)
    return rows.mapInArrow(by_group(GROUP, lambda rows: block_links(rows, percent)), "a long, b long")


def text_keys(text: str = "text") -> dict[str, Column]:
    """128 bits that tell texts apart, as two columns."""
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def similar_sets(texts: DataFrame, prints: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(set_key, component) for every set of ``prints``: equal components are sets that near copies connect.

    ``prints`` are the fingerprints of ``texts`` (k1, k2, text), with their keys. A set is one vertex however many texts
    have it, and only one text of it is read again. In every bucket of a band the vertices first meet the smallest of
    them, and components are formed; then those outside the bucket's largest component meet all of other components, so
    no candidate pair between components stays untested, while pairs within a component, which cannot change it, are
    never made. Both passes confirm pairs on full sets.
    """
    key = F.struct("k1", "k2")
    found = prints.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(key).alias("text_key"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = durable(found.withColumn("v", F.monotonically_increasing_id()))
    members = classes.select("v", "n", F.explode("bands").alias("bucket"))
    shared = durable(members.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min_by("n", "v").alias("low_n")).where("low < high").drop("high"))
    buckets = durable(members.join(shared, "bucket"))
    alike = F.least("n", "low_n") * 100 >= F.greatest("n", "low_n") * percent
    first = buckets.where((F.col("v") != F.col("low")) & alike).select(F.col("low").alias("a"), F.col("v").alias("b")).distinct()
    near = classes.join(buckets.select("v").distinct(), "v", "left_semi").select("v", "text_key.k1", "text_key.k2")
    own = texts.join(small(near), ["k1", "k2"]).groupBy("v").agg(F.first("text").alias("text"))
    sets = durable(whole_sets(own, width))
    links = durable(verified(first, sets, percent, block))

    placed = buckets.join(components(links).withColumnRenamed("component", "c"), "v", "left").select("bucket", "v", F.coalesce("c", "v").alias("c"))
    links = links.union(between_components(durable(placed), sets, percent, block))
    return classes.join(components(links), "v", "left").select("set_key", F.coalesce("component", "v").alias("component"))


def near_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``; see ``similar_sets``.

    Null or empty texts and texts without words have an empty set and are linked with nothing. Texts of any length are
    read whole; the sets of those that share a bucket move, 8 bytes a shingle. Rows of one id are one document, which is
    near to all that one of its texts is near to. A row without id is compared with nothing and kept. Ids may have any
    value of 64 bits. Other columns are not read.
    """
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).withColumns(text_keys())
    prints = durable(fingerprints(texts, width, bands, rows))
    sound = prints.where("id IS NOT NULL AND set_key IS NOT NULL")
    groups = durable(similar_sets(texts.where("id IS NOT NULL").drop("id"), sound, width, percent, block))
    member = durable(sound.select("id", "set_key").join(groups, "set_key").select("id", "component"))
    # An id with several texts connects their components.
    several = durable(member.groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high"))
    more = components(member.join(several, "id").select(F.col("component").alias("a"), F.col("low").alias("b")))
    member = member.join(durable(more).toDF("v", "joined"), F.col("component") == F.col("v"), "left").select("id", F.coalesce("joined", "component").alias("component"))
    least = durable(member.groupBy("component").agg(F.min("id").alias("component_id")))
    reached = durable(member.distinct().join(least, "component").select(F.col("id").alias("own"), "component_id"))
    answer = prints.select("id", "n_shingles").join(reached, F.col("id") == F.col("own"), "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return answer.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
