from __future__ import annotations

import random
import re

from pagewatch.llm.decontaminate import contained_items


def brute(docs, items, threshold=80):
    found = set()
    for item, text in items:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        width = min(5, len(words))
        own = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
        for doc, body in docs:
            w = re.findall(r"[^\W_]+", (body or "").lower())
            have = own & {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
            if own and 100 * len(have) >= threshold * len(own):
                found.add((doc, item, len(have), len(own)))
    return found


def test_same_as_all_pairs(spark):
    rng = random.Random(4)
    line = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(line(rng.choice([1, 2, 4, 5, 9, 14, 40, 59, 130])))) for i in range(60)] + [(90, ""), (91, None), (92, "..."), (None, "null item of seven words is here")]
    docs = [(i, " ".join(line(rng.choice([3, 50, 900])))) for i in range(80)] + [(800, ""), (801, None), (None, "x null item of seven words is here")]
    for i, (_, text) in enumerate(items[:50]):
        words = text.split()
        for _ in range(rng.randrange(1 + len(words) // 12)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((900 + i, " ".join(line(rng.choice([0, 30, 700])) + [", ".join(words).upper() + "!"] + line(20))))
    docs.append(docs[-1])
    schema = "doc_id long, text string, item_id string"
    got = contained_items(spark.createDataFrame([(*d, "x") for d in docs], schema), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(docs, items) and len(got) > 40
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(spark.createDataFrame([(*d, "x") for d in docs], schema), empty).collect() == []
