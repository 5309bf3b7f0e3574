from __future__ import annotations

import random
import re
from itertools import permutations

from pagewatch.llm.filter_audit import audit, interactions, packed, unpacked

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """Every order walked document by document."""
    marks = lambda k: {i for i, *m in labels if i is not None and m[k] == 1}
    good, toxic = marks(0), marks(1)
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, own in enumerate(order, 1):
                gone = [d for d in left if d[1][own]]
                left = [d for d in left if not d[1][own]]
                failing = [d for d in docs if d[0] == part and d[1][own]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[own] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_same_as_walking_every_order(spark):
    rng = random.Random(3)
    rows = []
    for i in range(250):
        text = " ".join(rng.choice(["é" * 3, "x", "Word", "y#", "z"] + [f"w{rng.randrange(400)}"] * rng.choice([1, 20])) for _ in range(rng.choice([3, 49, 50, 51, 90])))
        rows.append((i, rng.choice([text, text, rows[rng.randrange(i)][1] if i else text]), rng.choice(["hot", "hot", "b", "", None])))
    rows += [(900, None, "n"), (901, "", "n"), (902, " \t\x0b\r\n\f", "n"), (None, "", "n"), (None, rows[0][1], None), (3, rows[3][1], "hot"), (3, rows[3][1], "hot"), (950, "\xa0 \x1c", "n"), (951, "a b " * 100_000 + "A|", "long")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 250, 2)] + [(0, 1, None), (0, 0, 1), (None, 1, 1), (3, None, None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(7)
    assert got(audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == brute(rows, labels)


def test_no_overflow_and_other_filters(spark):
    n = (1 << 62) - 7
    fields = unpacked(sum(packed("ABCDE")[m] * n for m in (0, 31)), "ABCDE")
    assert len(fields) == 600 and (fields[:, 0] == n).all() and (fields[:, 1] + fields[:, 2] == n).all() and (fields[:, 1] == n).sum() == 120 and not fields[:, 3].any()
    few = got(interactions(spark.createDataFrame([("p", 3, 5, 2, 0), ("p", 1, 4, 0, 1)], "part string, mask int, n long, good long, toxic long"), "XY"))
    assert few == {("p", "XY", 1): (0, 9, 0, 4, 2, 1, 13), ("p", "XY", 2): (0, 0, 5, 0, 0, 0, 5), ("p", "YX", 1): (4, 5, 0, 0, 2, 0, 5), ("p", "YX", 2): (0, 4, 5, 4, 0, 1, 13)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs.limit(0), labels).collect() == []
    assert got(audit(docs, labels)) == brute([(1, "a", None)], [])
