from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from pagewatch.llm.sharding import stratified_shards


def test_mixture_counts_and_slots(spark):
    rng = random.Random(1)
    rows = [(i, "wörd " * rng.randrange(20), rng.choice(["big"] * 5 + ["a", "b", None])) for i in range(3000)]
    rows += [(3000 + i, "one", f"only{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = stratified_shards(df, piece_rows=40).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows)
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sources = dict((i, s) for i, _, s in rows)
    mix = Counter((sources[r.doc_id] if not str(sources[r.doc_id]).startswith("only") else "only", r.shard) for r in got)
    for name in ("big", "a", "b", None):
        share = sum(s == name for s in sources.values()) / 16
        assert all(abs(mix[name, k] - share) <= 12 for k in range(16))
    assert all(abs(mix["only", k] - 500 / 16) < 25 for k in range(16))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    other = stratified_shards(df.repartition(3), piece_rows=700).collect()
    assert sorted(map(str, other)) == sorted(map(str, got))


def test_mixture_within_a_row_or_two(spark):
    rows = [(i, "t", ("big", "big", "big", "a", "b")[i * 7 % 5]) for i in range(4000)]
    got = stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), piece_rows=30).collect()
    mix = Counter((rows[r.doc_id][2], r.shard) for r in got)
    assert all(abs(n - {"big": 150, "a": 50, "b": 50}[name]) <= 2 for (name, _), n in mix.items())


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, 1), (None, None, None, 2), (1, "", "x", 3), (1, "", "x", 3)], "doc_id long, text string, source string, slot int")
    got = stratified_shards(df, shards=3).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 1] and sorted(Counter(r.shard for r in got).values()) == [1, 1, 2]
    assert stratified_shards(df.limit(0)).collect() == []
