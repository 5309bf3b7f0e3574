from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pagewatch.llm.quality_mil import FEATURES, Model, fit, gradients, learn, passages, score


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 400))]
        bad = rng.random() < 0.3
        if bad:
            at = rng.randrange(len(words) // 2 + 1)
            junk = rng.choice([lambda w: w.upper() + "!!", lambda w: w + "%%%", lambda w: words[0]])
            words[at : at + 150] = [junk(w) for w in words[at : at + 150]]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_passages_cover_whole_texts():
    texts = [b"", b"  \n", b"one", b"w " * 48, b"w " * 49, "é ü\n".encode() * 500]
    x, bags = passages(texts)
    assert bags.tolist() == [1, 1, 1, 1, 2, 21] and x.shape == (27, FEATURES) and np.isfinite(x).all() and not x[:2].any()
    for i, text in enumerate(texts):  # a text's passages do not depend on its neighbours
        alone, own = passages([text])
        assert own[0] == bags[i] and np.allclose(alone, x[bags[:i].sum() : bags[: i + 1].sum()], atol=0.02)


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    x, bags, y = rng.normal(size=(40, 5)), np.array([7, 1, 12, 20]), np.array([1.0, 0, 1, 0])
    model = fit(x, bags, y, steps=3)
    loss = lambda: -np.mean(y * np.log(model.score(x, bags)) + (1 - y) * np.log(1 - model.score(x, bags)))
    for name, d in gradients(model, x, bags, y, np.full(4, 0.25)).items():
        flat = model.weights[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 4)):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-5 == pytest.approx(d.reshape(-1)[k], rel=1e-3, abs=1e-7), name


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (7000, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 != 2] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = learn(df, labels, sample=300)
    got = {r.doc_id: r for r in score(df, model).collect()}
    tried = [(got[i], q) for i, _, q in rows if got[i].held_out]
    assert len(got) == 502 and len(tried) > 80 and sum(r.predicted == q for r, q in tried) / len(tried) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and got[None].score == got[7000].score
    assert score(df.limit(0), model).collect() == [] and learn(df, labels.where("quality = 1")) is None
    assert {r.score for r in score(df.limit(3), None).collect()} == {0.5}
    assert isinstance(model, Model)
