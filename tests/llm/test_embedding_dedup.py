from __future__ import annotations

import math
import random

import numpy as np

from pagewatch.llm.embedding_dedup import near_copies, plan
from tests.llm.helpers import smallest_reached


def corpus():
    rng = np.random.default_rng(7)
    rows, n = [], 1
    for _ in range(60):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((n, (base * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0, 0.1, 0.45, 2])).tolist()))
            n += 1
        rows.append((n, rows[-1][1]))
        n += 1
    hot = rng.normal(size=16)
    rows += [(n + i, hot.tolist()) for i in range(200)] + [(n + 200 + i, (hot + rng.normal(size=16) * 0.05).tolist()) for i in range(150)]
    random.Random(1).shuffle(rows)
    bad = [None, [], [0.0] * 16, [1.0, None] * 8, [math.nan] * 16, [math.inf] + [1.0] * 15, [1.0, 2.0], [1e200] * 16]
    return rows + [(5000 + i, b) for i, b in enumerate(bad)]


def brute(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    counts, links = {i: 0 for i, _ in rows}, []
    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b):
                a1, b1 = a / np.abs(a).max(), b / np.abs(b).max()
                if a1 @ b1 / math.sqrt((a1 @ a1) * (b1 @ b1)) >= threshold:
                    counts[i] += 1
                    counts[j] += 1
                    links.append((i, j))
    reached = smallest_reached([i for i, _ in rows], links)
    return {i: (counts[i], reached[i], reached[i] == i) for i, _ in rows}


def test_same_as_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted = brute(rows, 0.9)
    for block, bucket in ((512, 64), (20, 4)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_copies(df, block=block, bucket=bucket).collect()}
        assert got == wanted


def test_edges(spark):
    rows = [(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 2), (3, [1.0, 2.0], 2), (9, [2.0, 4.0], None), (4, [-1.0, 0.0], 1), (5, [-1.0, -0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id int")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_copies(df).collect()), key=str)
    assert got == sorted([(-1, 0, None, True), (3, 1, 3, True), (3, 1, 3, True), (9, 1, 3, False), (4, 1, 4, True), (5, 1, 4, False)], key=str)
    assert near_copies(df.limit(0)).collect() == []


def test_plan_meets_its_bound():
    for n in (1, 100, 50_000, 10**9):
        signs, tables = plan(n, 0.9)
        assert (1 - (1 - math.acos(0.9) / math.pi) ** signs) ** tables <= 1e-4
