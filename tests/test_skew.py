"""Hot keys: the forms that work in pieces must give what the plain forms give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagewatch.operators import digest, frontier, signals, state
from pagewatch.operators.folding import keyed_fold
from pagewatch.operators.ordered import GROUP_ROWS, PIECES, numbered, piece_count, running

RNG = random.Random(5)


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most rows, some with few, and one that is NULL."""
    keys = ["hot"] * 600 + [f"k{RNG.randrange(30)}" for _ in range(300)] + [None] * 40
    rows = [(i, key, RNG.choice([None, RNG.randrange(1000)])) for i, key in enumerate(keys)]
    RNG.shuffle(rows)
    return spark.createDataFrame(rows, "seq bigint, key string, value bigint").repartition(6).cache()


KINDS = {"total": "sum", "n": "count", "low": "min", "high": "max"}


@pytest.mark.parametrize("through", [True, False])
def test_running_in_pieces(hot, through):
    columns = {name: (kind, F.col("value")) for name, kind in KINDS.items()}
    plain = running(hot, ["key"], ["seq"], columns, through)
    pieces = running(hot, ["key"], ["seq"], columns, through, group_rows=70)
    assert pieces.columns == plain.columns
    assert sorted(map(repr, pieces.collect())) == sorted(map(repr, plain.collect()))


def test_numbering_the_whole_table(hot):
    placed = numbered(hot, [], ["seq"], "place", group_rows=100)
    assert {r["seq"]: r["place"] for r in placed.collect()} == {i: i + 1 for i in range(940)}


def test_no_piece_holds_a_hot_key(hot):
    from pagewatch.operators.ordered import CHUNK, chunked

    sizes = [r["count"] for r in chunked(hot, ["key"], ["seq"], 70, 940).groupBy(CHUNK).count().collect()]
    assert max(sizes) < 300


def test_breaker_against_a_loop(spark):
    rules = signals.BreakerRules(alert_at=3, stop_at=6, cooldown=50)
    rows, time = [], 0
    for i in range(2500):
        time += RNG.randrange(1, 9)
        status = RNG.choice([200, 200, 500, 500, 500, None, 403 if i % 50 == 0 else 500, 404])
        rows.append((i, ("hot" if i % 3 else None) if i % 10 else f"k{i % 70}", time, status, status is None, RNG.choice([0, 1, 2, 3, 4]) if i % 9 == 0 else 5))
    table = spark.createDataFrame(rows, "seq bigint, job string, time bigint, status int, failed boolean, selector_matches int").repartition(5)
    states, expected = {}, {}
    for seq, job, at, status, failed, matches in rows:
        states[job], result = rules.step(states.get(job, (0.0, 0.0)), (at, status, failed, matches))
        expected[seq] = (*result, *states[job])
    got = signals.circuit_breaker(table, "job", ["time", "seq"], rules, group_rows=100)
    assert {r["seq"]: (r["action"], r["alerts"], r["fail_count"], r["stop_time"]) for r in got.collect()} == expected
    last = signals.last_state(got, "job", ["time", "seq"], signals.BREAKER_STATE)
    assert {r["job"]: (r["fail_count"], r["stop_time"]) for r in last.collect()} == states


def test_fold_that_never_resets(spark):
    """Every piece depends on the one before it: a running product modulo a prime over a single key."""
    rows = [(i, 1, i % 97 + 2) for i in range(400)]
    table = spark.createDataFrame(rows, "seq bigint, key bigint, x bigint").repartition(4)

    def step(kept, row):
        value = (kept[0] * row[0] + 1) % 10007
        return (value,), (int(value),)

    got = {r["seq"]: r["out"] for r in keyed_fold(table, "key", ["seq"], ["x"], (1.0,), step, "out bigint", None, ["v"], group_rows=30).collect()}
    value = 1
    for seq, _, x in rows:
        value = (value * x + 1) % 10007
        assert got[seq] == value


def test_breaker_rules():
    rules = signals.BreakerRules()
    closed = (0.0, 0.0)
    assert rules.step(closed, (1, 403, False, 1)) == ((50.0, 1), ("fetched", "banned"))
    assert rules.step((29.0, 0.0), (1, 500, False, 1)) == ((30.0, 0.0), ("fetched", "failing"))
    assert rules.step((49.0, 0.0), (7, None, True, None)) == ((50.0, 7), ("fetched", "stopped"))
    assert rules.step((50.0, 7), (8, 200, False, 1)) == ((50.0, 7), ("skipped", ""))
    assert rules.step((50.0, 7), (7 + 86_400, 200, False, 1)) == ((0.0, 0.0), ("probe", "recovered"))
    assert rules.step((50.0, 7), (7 + 86_400, 500, False, 1)) == ((51.0, 7 + 86_400), ("probe", ""))
    assert rules.step((5.0, 0.0), (1, 404, False, 1)) == ((5.0, 0.0), ("fetched", "missing"))
    assert rules.step((30.0, 0.0), (9, 200, False, 0)) == ((50.0, 9), ("fetched", "recovered,layout"))


def test_price_alerts(spark):
    rows = [(1, "a", "$10"), (2, "a", "12"), (3, "a", "$9.50"), (4, "a", "free"), (5, "a", "9.5"), (6, "b", "$2,000,000"), (7, "b", "1,999")]
    table = spark.createDataFrame(rows, "seq bigint, id string, price string")
    from pagewatch.functions.text import price

    got = signals.price_alerts(table, "id", ["seq"], price(F.col("price")), F.when(F.col("seq") == 2, "Big Sale").otherwise("x"))
    assert {r["seq"]: (r["prior_min"], r["alert"]) for r in got.collect()} == {
        1: (999999.0, "price_drop"), 2: (10.0, "sale"), 3: (10.0, "price_drop"), 4: (9.5, None), 5: (9.5, None),
        6: (999999.0, None), 7: (999999.0, "price_drop"),
    }


def test_counters_like_the_store(spark):
    log = [
        (1, "c", "incr", None, 0, 1), (2, "c", "incr", None, 0, 5), (3, "c", "incr", None, 100, 1),
        (1, "s", "set", "100", None, None), (2, "s", "incr", None, 7, 1),
        (1, "t", "set", "abc", None, None), (2, "t", "incr", None, 7, 1), (3, "t", "incr", None, 9, 1),
        (1, "d", "set", "1", None, None), (2, "d", "delete", None, None, None),
        (1, "e", "set", "1", None, None), (2, "e", "delete", None, None, None), (3, "e", "incr", None, 40, 2), (4, "e", "set", "x", None, None),
        (1, "f", "delete", None, None, None), (2, "f", "incr", None, 40, 2),
    ]
    table = spark.createDataFrame(log, "seq bigint, key string, op string, value string, default bigint, delta bigint")
    expected = {"c": "7", "s": "101", "t": "9", "e": "x", "f": "42"}
    for rows in (100, 1):
        assert {r["key"]: r["value"] for r in state.folded(table, group_rows=rows).collect()} == expected


def test_webhook_parts_of_a_hot_job(spark):
    items = spark.range(250).select(
        F.lit("j").alias("job_id"), F.lit("J").alias("job_name"), F.col("id"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("fields"),
        F.array().cast("array<string>").alias("matches"),
    )
    parts = digest.webhook_payloads(items, ["id"], part_items=40, group_rows=60).orderBy("part").collect()
    assert [(r["part"], r["parts"], r["item_count"]) for r in parts] == [(i, 7, 250) for i in range(1, 8)]
    import json

    listed = [item["n"] for r in parts for item in json.loads(r["payload"])["items"]]
    assert listed == [str(i) for i in range(250)]


def test_lanes_cover_the_batch(spark):
    dealt = frontier.lanes(spark.range(100), 7, ["id"], group_rows=20)
    assert {r["id"]: r["lane"] for r in dealt.collect()} == {i: i % 7 + 1 for i in range(100)}


def test_pieces_do_not_grow_with_the_rows():
    assert piece_count(1000, 50, 8) == 20 and piece_count(0, 50, 8) == 1
    assert piece_count(36_000_000, 2000, 8) == piece_count(72_000_000, 2000, 8) == PIECES
    assert piece_count(1000 * GROUP_ROWS, 50, 8) == 1000
