from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from pagewatch.llm.language_ppm import CLASSES, DEPTH, PAD, learn, predict

SYLLABLES = {"aa": ["tha", "ing", "er", "ou", "st"], "bb": ["ción", "que", "ñas", "do", "el"], "cc": ["schü", "ung", "ver", "ein", "ß"]}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))).capitalize() + ".", lang))
    return rows


def plain_bits(training, text, least_share):
    """The same code lengths by walking the contexts of every byte."""
    signs = lambda t: [PAD] * DEPTH + [int(CLASSES[b]) for b in t.encode()]
    grams = {lang: defaultdict(Counter) for _, _, lang in training}
    size = Counter()
    for _, t, lang in training:
        s = signs(t)
        for i in range(DEPTH, len(s)):
            size[lang] += 1
            for k in range(DEPTH + 1):
                grams[lang][tuple(s[i - k : i])][s[i]] += 1
    known = {c for lang, by in grams.items() for c, n in by.items() if not c or sum(n.values()) >= max(1.0, size[lang] * least_share)}
    used = {x for by in grams.values() for x in by[()]}
    out = {}
    for lang, by in grams.items():
        bits, s = 0.0, [x if x in used else -1 for x in signs(text)]
        for i in range(DEPTH, len(s)):
            for k in range(DEPTH, -1, -1):
                context = tuple(s[i - k : i])
                n = by.get(context) if context in known else None
                if not n:
                    continue
                total, kinds = sum(n.values()), len(n)
                if s[i] in n:
                    bits += math.log2((total + kinds) / n[s[i]])
                    break
                bits += math.log2((total + kinds) / kinds)
            else:
                bits += math.log2(len(used) + 1)
        out[lang] = bits
    return out


def test_code_lengths_and_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(df, least_share=2e-3)
    for text in ["thaing elque.", "schüein 7 日 q", "x", rows[0][1] * 3]:
        wanted = plain_bits(rows, text, 2e-3)
        for lang, bits in zip(model.languages, model.bits(["zz".encode(), text.encode(), b"", b"k"])[1]):
            assert abs(bits - wanted[lang]) < 1e-3 * max(1, bits), (text, lang)
    fresh = corpus(120, 77)
    got = {r.doc_id: r for r in predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in fresh)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "123 ... !?", None), (None, "thaing", None), (5, "thaing", "aa"), (5, "thaing", "aa"), (6, "elque", None), (7, "½ ² ① Ⅷ _", "aa")], "doc_id long, text string, lang string")
    model = learn(df)
    got = sorted(((r.doc_id or 0, r.lang_pred, r.held_out) for r in predict(df.withColumnRenamed("lang", "lang_pred"), model).collect()))
    assert [x[:2] for x in got] == [(0, "aa"), (1, "und"), (2, "und"), (3, "und"), (5, "aa"), (5, "aa"), (6, "aa"), (7, "und")] and got[0][2]
    assert predict(df.limit(0), model).collect() == []
    assert {r.lang_pred for r in predict(df, learn(df.limit(0))).collect()} == {"und"}
