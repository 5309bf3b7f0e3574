from __future__ import annotations

import hashlib
import random
import re
import time
from itertools import product

import numpy as np
import pytest

from pagewatch.llm import pii_crf as crf

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return [(kind, m.start(), m.end()) for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text or "") if passes(kind, m[0])]


def lines(seed, n):
    rng = random.Random(seed)
    parts = ["a", "Z.", "@", "@@", "b.c", "-", "_", "%", "+", "+1", " ", " ", "\n", "\x0b", "é", "😀", ".", "..", "(", ")", "12", "255", "256", "0010", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "x@y.z", "+49 (30) 1234-5678", "q@r", "9" * 21, "1.2.3.4.5.6.7.8", "٣", "５"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def field():
    return crf.learn()


def test_base_spans_are_those_of_the_patterns():
    for text in [*lines(1, 6000), *(t for t, _ in crf.labelled_rows(300, 5))]:
        raw = text.encode()
        assert [(crf.KINDS[k], len(raw[:a].decode()), len(raw[:b].decode())) for k, a, b in crf.base_spans(raw)] == base(text), text


def small_field(seed, size=len(crf.LABELS)):
    rng = np.random.default_rng(seed)
    return rng.normal(size=size) + np.where(crf.STARTS_CLOSED, crf.NEVER, 0), rng.normal(size=(size, size)) + np.where(crf.CLOSED, crf.NEVER, 0), rng


def test_viterbi_and_expectations_against_all_labellings():
    start, step, rng = small_field(3)
    lengths = np.array([1, 3, 2, 3, 1])
    scores = rng.normal(size=(lengths.sum(), len(crf.LABELS))) * 2
    got, at = crf.Field({}, np.zeros((1, len(crf.LABELS))), start, step).decode(lengths, scores), 0
    for length in lengths:
        own, weights = scores[at : at + length], {}
        for path in product(range(len(crf.LABELS)), repeat=int(length)):
            weights[path] = start[path[0]] + sum(own[k][x] for k, x in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))
        assert tuple(got[at : at + length]) == max(weights, key=weights.get)
        chances, pairs, whole = crf.expectations(own[None], start, step)
        total = sum(np.exp(w) for w in weights.values())
        assert np.isclose(whole[0], np.log(total)) and np.allclose(chances.sum(axis=2), 1)
        assert np.isclose(chances[0, -1, 0], sum(np.exp(w) for p, w in weights.items() if p[-1] == 0) / total)
        assert np.isclose(pairs.sum(), length - 1) and (length < 2 or np.isclose(pairs[1, 2], sum(np.exp(w) * sum(x == (1, 2) for x in zip(p, p[1:])) for p, w in weights.items()) / total))
        at += length


def spans_of(field, text):
    raw = text.encode()
    return [(crf.KINDS[k], raw[a:b].decode()) for k, a, b in crf.added_spans(field, [raw], [crf.base_spans(raw)])[0]]


def test_fresh_lines(field):
    right = wrong = missed = 0
    for text, spans in crf.labelled_rows(600, seed=77):
        raw = text.encode()
        got = {(crf.KINDS[k], len(raw[:a].decode()), len(raw[:b].decode())) for k, a, b in crf.added_spans(field, [raw], [[]])[0]}
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right > 400 and wrong <= 0.03 * right and missed <= 0.03 * right


def test_written_by_hand(field):
    assert spans_of(field, "Bitte anrufen: Telefon (030) 555-1234, danke") == [("phone", "(030) 555-1234")]
    assert spans_of(field, "her number is 743-555-3824.") == [("phone", "743-555-3824")]
    assert spans_of(field, "call 743 555 3824 today") == [("phone", "743 555 3824")]
    assert spans_of(field, "paid by card 4111/1111/1111/1111 yesterday") == [("card", "4111/1111/1111/1111")]
    assert spans_of(field, "from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 on") == [("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]
    assert spans_of(field, "write to anna@[192.168.7.20] now") == []  # touches the base span of the ip
    for clean in ("In 1984 there were 12 345 of them, on 12.03.2021 at 10:20:30", "version 1.2.3 of build 20240105", "4111 1111 1111 1112 is no card", "sum 300.400.500.600 and 1,234.56", 'key "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "@anna said #123456 @ 7", "no figures here at all"):
        assert spans_of(field, clean) == [], clean


def test_whole_operator(spark, field):
    rows = [(k, t) for k, t in enumerate(lines(9, 200))] + [(500, None), (501, ""), (501, ""), (None, "mail x@y.zz"), (502, "é call (743) 555-3824, x@y.z +1 (743) 555-3824"), (503, "word " * 200_000 + "+1 (743) 555-3824"), (504, "a" * 1_000_000 + "@" + "1" * 1_000_000 + ".")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, spans string, id int").repartition(4)
    found = crf.personal_data(df, field)
    got = crf.digests(found).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        own = base(texts[r.doc_id]) if r.doc_id != 504 else []
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in own) for kind in crf.KINDS]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and {*listed.split(",")} - {""} <= {*r.spans.split(",")}
    assert {r.doc_id: r.spans for r in got}[502] == "email:23:28,phone:7:21,phone:29:46"
    clean = {r.doc_id: r.text for r in crf.personal_data(df, field, masked=True).collect()}
    assert clean[502] == "é call [PHONE], [EMAIL] [PHONE]" and clean[500] == "" and clean[None] == "mail [EMAIL]"
    assert crf.personal_data(df.limit(0), field).collect() == []


def test_labelled_tables_and_time(spark, field):
    table = crf.labelled_table(spark)
    assert table.count() == crf.LABELLED_ROWS
    other = crf.learn(table.limit(300), rows=300)
    assert spans_of(other, "her number is 743-555-3824.") == [("phone", "743-555-3824")]
    began = time.time()
    for text in (b"a" * 3_000_000, b"1." * 1_000_000, b"+1 " * 500_000, b"x@" * 500_000, b"a1 " * 20_000, b"1" * 3_000_000, b"+1" + b" " * 2_000_000, b"x\n" * 1_000_000 + b"7"):
        crf.added_spans(field, [text], [crf.base_spans(text)])
    assert time.time() - began < 30
