from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from pagewatch.llm.common import components
from pagewatch.llm.minhash_dedup import near_copies, super_minhash
from tests.llm.helpers import shingles, smallest_reached


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    reached = smallest_reached(sets, links)
    return {i: (len(sets[i]), reached[i], reached[i] == i) for i in sets}


def corpus():
    rng = random.Random(5)
    rows, n = [(1, ""), (2, None), (3, " \t\n "), (4, "one two"), (5, "ONE two"), (6, "a b c d"), (7, "x" * 5000)], 10
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 30, 90, 400]))]
        for edits in range(9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
        rows.append((n, " ".join(base).upper()))
        n += 1
    rng.shuffle(rows)
    return rows


def test_same_as_all_pairs(spark):
    rows = corpus()
    for block in (256, 5):
        got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), width=4, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4, 80)


def test_large_group_of_copies_of_copies(spark):
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(500):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), width=4, block=60).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4, 80)


def test_edges(spark):
    rows = [(None, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (7, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_copies(df).collect()), key=str)
    assert got == sorted([(-1, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (7, 2, 1, False)], key=str)
    assert near_copies(df.limit(0)).collect() == []


def test_large_ids_several_texts_of_an_id_and_long_texts(spark):
    top = 2**63 - 1
    long = [f"w{i}" for i in range(300_000)]
    rows = [(top - k, "one two three four five six seven eight nine ten " + extra) for k, extra in enumerate(["", "", " ", "one two three"])]
    rows += [(-(2**63), " ".join(long)), (5, " ".join(long[:-9])), (6, "other words of one id here and now"), (6, " ".join(long[9:])), (8, "other words of one id here and now"), (9, "w " * 200_000)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    low = top - 3 if shingles(rows[3][1], 4) == shingles(rows[0][1], 4) else top - 2
    wanted = {top: low, top - 1: low, top - 2: low, top - 3: top - 3, -(2**63): -(2**63), 5: -(2**63), 6: -(2**63), 8: -(2**63), 9: 9}
    assert got == {k: (c, k == c) for k, c in wanted.items()}


def test_components_of_numbers_of_many_partitions(spark):
    number = lambda k: (k % 5000 << 33) + k // 5000  # noqa: E731  as monotonically_increasing_id gives them
    links = [(number(k), number(k + 1)) for k in range(0, 20_000) if k % 100 != 99]
    got = {r.v: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[number(k)] == min(number(j) for j in range(k // 100 * 100, k // 100 * 100 + 100)) for k in range(0, 20_000, 37))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        cut = int(1000 * share)
        pair = super_minhash([pool[:1000], pool[1000 - cut : 2000 - cut]], 512)
        errors.append((pair[0] == pair[1]).mean() - cut / (2000 - cut))
    assert max(map(abs, errors)) < 0.07


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300, 400)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, i) for i in range(500, 900)] + [(950, 950)]
    got = {r.v: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest_reached({v for link in links for v in link}, links)


def test_few_links_are_joined_in_one_step(spark):
    context, rng = spark.sparkContext, random.Random(4)
    links = [(i, i + 1) for i in range(1200, 3000) if i % 700] + [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(7, 7), (5000, 5000)]
    table = spark.createDataFrame(links, "a long, b long").repartition(8)
    got, jobs = {}, {}
    for few in (0, 100_000):
        context.setJobGroup(f"few {few}", "components")
        got[few] = {r.v: r.component for r in components(table, few).collect()}
        jobs[few] = len(context.statusTracker().getJobIdsForGroup(f"few {few}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[100_000] == smallest_reached({v for link in links for v in link}, links)
    assert jobs[100_000] < jobs[0] / 2
    assert components(table.limit(0)).count() == 0
