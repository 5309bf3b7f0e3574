from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from itertools import product

import pytest

from pagewatch.llm.conversation_repair import BLOCK_TURNS, ENDS, NONE, cheapest, damaged, repaired, ways_through

SPACE = " \t\n\x0b\f\r"
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain(rows):
    """One conversation, over all prefixes and ends of them: the least (cost, audit) and what it yields."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    blank = duplicate = truncated = illegal = 0
    seen, faults = set(), []
    for k, (_, _, role, text) in enumerate(rows):
        shown = text.strip(SPACE)
        fault = "gone" if not shown or (role, text) in seen else "cut" if shown[-1] not in ".!?" else ""
        blank, duplicate, truncated = blank + (not shown), duplicate + (bool(shown) and fault == "gone"), truncated + (fault == "cut")
        seen.add((role, text))
        faults.append(fault)
        illegal += k > 0 and rows[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
    turns = {r[1] for r in rows if r[1] is not None}
    best = {"": (0, "", "")}  # by role of what stands last ("" at the start): cost, audit, lines

    def put(to, key, value):
        if key not in to or value < to[key]:
            to[key] = value

    def insert(states):
        for _ in range(3):
            for last, (cost, audit, lines) in list(states.items()):
                new = "a" if last == "u" else "u"
                put(states, new, (cost + 3, audit + "I", lines + ("\n" if lines else "") + ("assistant:" if new == "a" else "user:")))

    for (_, _, role, text), fault in zip(rows, faults):
        insert(best)
        after = {}
        for last, (cost, audit, lines) in best.items():
            put(after, last, (cost + 4, audit + "D", lines))
            if fault != "gone":
                extra = 3 * (fault == "cut")
                for edit, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if name[:1] and (last, name[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                        put(after, name[:1], (cost + price + extra, audit + edit, lines + ("\n" if lines else "") + f"{name}:{text}"))
        best = after
    insert(best)
    cost, audit, lines = min(best[k] for k in ("", "a") if k in best)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def conversations(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        n = rng.randrange(1, longest)
        for t in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("system" if t == 0 else ("assistant", "user")[t % 2])
            role = rng.choice(["system", "tool", "", None]) if rng.random() < 0.1 else role
            text = rng.choice([f"tëxt {rng.randrange(10**6)}.", f"text\n{rng.randrange(30)}", "ok!", "what? ", " ", None, "é"])
            rows.append((c, rng.choice([t, t, t, t, None, t + 5]), role, text))
    return rows


def got(df):
    out = {r.conv_id: tuple(r[c] for c in RESULT) for r in df.collect()}
    assert len(out) == df.count()
    return out


def wanted(rows):
    return {c: plain([r for r in harm(rows) if r[0] == c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("piece_rows", [20_000, 7])
def test_same_as_trying_everything(spark, piece_rows):
    rows = conversations(piece_rows, 150, 14) + [(1000, t, ("user", "assistant")[t % 3 == 1], f"hot {t % 211}.") for t in range(700)]
    rows += [(2000, None, None, None), (2001, 0, "user", "same.")] + [(2001, 0, "user", "same.")] * 300 + [(None, t, "user", "no id.") for t in range(5)] + [(-5, 2**62, "user", "a"), (-5, -(2**62), "user", "b.")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, piece string, copies int").repartition(5)
    assert got(repaired(damaged(df), copies_column="copies", piece_rows=piece_rows)) == wanted(rows)


def test_search_against_all_edit_sequences():
    legal = re.compile("(s?(ua)+)?")

    def walk(turns):
        best = None
        for marks in product("KDR", repeat=len(turns)):
            for inserts in product(range(3), repeat=len(turns) + 1):
                cost = 3 * sum(inserts)
                for roles in product("ua", repeat=marks.count("R") + sum(inserts)):
                    it, made, audit, price = iter(roles), "", "", cost
                    for k, mark in enumerate(marks):
                        made += "".join(next(it) for _ in range(inserts[k]))
                        audit += "I" * inserts[k] + mark
                        role, cut = divmod(turns[k], 2)
                        made += {"K": "suax"[role], "D": ""}[mark] if mark != "R" else next(it)
                        price += {"K": 0, "R": 3, "D": 4}[mark] + 3 * cut * (mark != "D")
                    made += "".join(next(it) for _ in range(inserts[-1]))
                    audit += "I" * inserts[-1]
                    if legal.fullmatch(made) and (best is None or (price, audit) < best):
                        best = (price, audit)
        return best

    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(8):
            turns = bytes(rng.randrange(8) for _ in range(n))
            assert cheapest(turns, NONE, ENDS) == walk(turns)


def test_blocks_agree_with_one_search_and_stay_fast():
    rng, began = random.Random(4), time.time()
    for weights in ([1] * 8, [8, 1, 8, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 0, 0, 0], [1, 0, 0, 1, 0, 1, 0, 0]):
        for n in (BLOCK_TURNS - 1, BLOCK_TURNS, 2 * BLOCK_TURNS + 9):
            turns = bytes(rng.choices(range(8), weights, k=n))
            ways = ways_through(turns, [0] * (n + 1), [NONE])
            assert cheapest(turns, NONE, ENDS) == min(ways[NONE, x] for x in ENDS if (NONE, x) in ways)
    assert time.time() - began < 20


def test_edges(spark):
    rows = [(7, 0, "user", "long " * 300_000 + "."), (7, 1, "assistant", "x" * 2_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(repaired(df)) == {7: plain(rows)}
    assert repaired(damaged(df.limit(0)), copies_column="copies").collect() == []
    gone = spark.createDataFrame([(1, None, None, None, 0), (1, 5, "user", "x", None)], "conv_id long, turn long, role string, text string, copies int")
    assert got(repaired(gone, copies_column="copies")) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
