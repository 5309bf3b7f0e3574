from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagewatch.operators import dedup, digest, filters, frontier, quality, records, signals, tables
from pagewatch.session import scratch
from pagewatch.sources import files
from pagewatch.sources.pages import accepted, attempts, quarantined
from pagewatch.spec import FieldSpec, JobSpec, Notification, spec_table


def test_dedup_twice(spark):
    first = spark.createDataFrame([(0, "1"), (1, "2"), (2, "1")], "ord int, hash string")
    new = dedup.new_items(first, first.limit(0), ["ord"])
    assert sorted(r["ord"] for r in new.collect()) == [0, 1]
    second = spark.createDataFrame([(0, "1"), (1, "3"), (2, "3")], "ord int, hash string")
    assert [tuple(r) for r in dedup.new_items(second, new, ["ord"]).select("ord", "hash").collect()] == [(1, "3")]


def test_copies_are_thinned_before_the_shuffle(spark):
    items = spark.range(1000).select(F.concat(F.lit("h"), (F.col("id") % 2).cast("string")).alias("hash"), "id")
    plan = dedup.first_of_each(items, ["hash"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.fixture(scope="module")
def stored(spark):
    rows = [("a", {"t": str(i)}, i * 10, i, f"h{i}", ["k"]) for i in range(10)] + [("b", {"t": "x"}, 5, i, f"b{i}", []) for i in range(5)]
    return spark.createDataFrame(
        rows, "job_id string, fields map<string,string>, ts_ns bigint, ord int, hash string, match_key array<string>"
    ).cache()


def test_keyset_paging(stored):
    sizes, seen, after = [], [], None
    while True:
        page = records.keyset_page(stored, "a", 3, after).collect()
        sizes.append(len(page))
        seen += [r["ts_ns"] for r in page]
        if len(page) < 3:
            break
        after = page[-1]["ts_ns"]
    assert sizes == [3, 3, 3, 1] and seen == sorted(seen, reverse=True) and len(set(seen)) == 10


def test_keyset_paging_with_equal_times(stored):
    cursor, seen = (None, None), []
    while page := records.keyset_page(stored, "b", 2, *cursor).collect():
        seen += [r["ord"] for r in page]
        cursor = (page[-1]["ts_ns"], page[-1]["ord"])
    assert seen == [4, 3, 2, 1, 0]


def test_cursor_goes_on_among_equal_times_and_places(spark):
    rows = spark.createDataFrame([("c", {"t": "x"}, 5, i % 3, f"h{i:02}", []) for i in range(25)], "job_id string, fields map<string,string>, ts_ns bigint, ord int, hash string, match_key array<string>").cache()
    seen, cursor, more = [], (None, None, None), True
    while more:
        page = records.page_envelope(rows, "c", 4, *cursor).first()
        seen += [(r["ord"], r["hash"]) for r in page["records"]]
        more, cursor = page["has_more"], (page["next_after"], page["next_after_ord"], page["next_after_hash"])
    assert seen == sorted(((i % 3, f"h{i:02}") for i in range(25)), reverse=True)
    assert not records.page_envelope(rows, "c", 0).first()["has_more"]


@pytest.mark.parametrize("group_rows", [1_000_000, 7])
def test_page_index_equals_reading_with_cursors(spark, group_rows):
    """Jobs of several sizes with equal times and places; every page read alone is the page that the cursors lead to."""
    rows = spark.createDataFrame(
        [(job, {}, 5 + i // 11, 0, i % 3, f"h{i * 7 % 41:02}", []) for job, n in (("a", 41), ("b", 12), ("c", 1)) for i in range(n)],
        "job_id string, fields map<string,string>, ts_ns bigint, page_id bigint, ord bigint, hash string, match_key array<string>",
    )
    index = {(r["job_id"], r["page"]): r for r in records.page_index(rows, 6, group_rows).collect()}
    shown = {}
    for r in records.paged(rows, 6, group_rows).collect():
        shown.setdefault((r["job_id"], r["page"]), set()).add(r["hash"])
    assert {k: len(v) for k, v in shown.items()} == {k: r["rows"] for k, r in index.items()}
    assert {job: max(p for j, p in index if j == job) for job in "abc"} == {"a": 7, "b": 2, "c": 1}
    for (job, page), r in index.items():
        if job != "a" or page in (1, 2, 7):
            alone = records.keyset_page(rows, job, 6, r["after"], r["after_ord"], r["after_hash"]).collect()
            assert {x["hash"] for x in alone} == shown[job, page]
    assert records.page_index(rows, 0).collect() == [] and records.page_index(rows.limit(0), 6).collect() == []


def test_csv_gives_every_text_back(spark):
    texts = [" pad ", "", None, 'a"b,c', "line\nbreak\r\nx", "back\\slash\\", '"', '\\"', "\t", "x\ry", "#c", '""']
    rows = list(enumerate(texts))
    path = f"{scratch(spark)}/a.csv"
    files.write_file(spark.createDataFrame(rows, "i int, t string"), path, "overwrite")
    assert sorted(tuple(r) for r in files.read_file(spark, path, "i int, t string").collect()) == rows


def test_newest_per_job(stored):
    found = records.newest(stored, 2).collect()
    assert sorted((r["job_id"], r["ord"]) for r in found) == [("a", 8), ("a", 9), ("b", 3), ("b", 4)]
    assert records.newest(stored, None).count() == 15
    assert records.newest(stored, records.RANK_LIMIT + 1).count() == 15


@pytest.mark.parametrize(("asked", "size"), [(None, 30), ("x", 30), ("7", 7), (5000, 1000), ("-1", 30), ("1_000", 30), (" 7", 30), (7.0, 30), ("+7", 7), ("٣", 30)])
def test_page_size(asked, size):
    assert records.page_size(asked) == size


def test_envelope(stored):
    page = records.page_envelope(stored, "a", "4").first()
    assert (page["has_more"], page["next_after"], page["limit"]) == (True, 60, 4)
    assert [r["ord"] for r in page["records"]] == [9, 8, 7, 6] and page["records"][0]["date_time"] == "1970-01-01T00:00:00Z"
    last = records.page_envelope(stored, "a", "4", after=20).first()
    assert (last["has_more"], last["next_after"], len(last["records"])) == (False, None, 2)
    assert records.page_envelope(stored, "none").first()["records"] == []


def run_items(spark, count):
    rows = [("j", "Job", i, {"job_title": f"T{i}", "blank": " ", "b": "x", "c": "y", "d": "z", "e": "w", "f": "v"}, ["k1"] if i else ["k2", "k1"]) for i in range(count)]
    return spark.createDataFrame(rows, "job_id string, job_name string, ord int, fields map<string,string>, matches array<string>")


def test_default_digest(spark):
    order = ["job_title", "blank", "job_title", "b", "c", "d", "e", "f"]
    row = digest.digests(run_items(spark, 5), ["ord"], order).first()
    assert row["title"] == "5 new matches from Job" and row["body"].endswith("\n---\n+ 2 more")
    assert row["body"].split("\n---\n")[0] == "Job title: T0\nB: x\nC: y\nD: z\nE: w\nKeywords: k2, k1".replace("Job title", "Job Title")
    assert digest.digests(run_items(spark, 1), ["ord"], order).first()["title"] == "New match from Job"
    assert digest.digests(run_items(spark, 0), ["ord"], order).collect() == []


def test_template_digest(spark):
    told = Notification(title=" {matches} {match_count} {url} ", body="{job_title}/{item_count}/{gone}")
    row = digest.digests(run_items(spark, 2), ["ord"], ["job_title"], told, F.lit("U"), F.lit(9)).first()
    assert (row["title"], row["body"]) == ("k2, k1 2 U", "T0/2/\n---\nT1/2/")
    assert digest.digests(run_items(spark, 2), ["ord"], ["x"], Notification(title="{gone}")).first()["title"] == "2 new matches from Job"
    assert digest.digests(run_items(spark, 2), ["ord"], ["x"], Notification(enabled=False)).collect() == []


def test_payload_is_json(spark):
    rows = [("j", 'J "q"', 1, {"b": 'x"\\\n', "a": "é", "keywords": "mine"}, ["k"]), ("j", 'J "q"', 2, {"keywords": "mine"}, [])]
    items = spark.createDataFrame(rows, "job_id string, job_name string, ord int, fields map<string,string>, matches array<string>")
    payload = digest.webhook_payloads(items, ["ord"]).first()["payload"]
    assert json.loads(payload) == {
        "job_name": 'J "q"', "item_count": 2, "items": [{"a": "é", "b": 'x"\\\n', "keywords": ["k"]}, {"keywords": "mine"}],
    }
    assert payload.index('"a"') < payload.index('"b"')


def seeds(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "src string, dst string, pos int")


def test_frontier_counts(spark):
    visited, counts = frontier.expand(seeds(spark, "u1"), edges(spark, ("u1", "dup"), ("u1", "dup"), ("u1", "u1")))
    assert {(r["url"], r["wave"]) for r in visited.collect()} == {("u1", 0), ("dup", 1)}
    assert tuple(counts.first()) == (2, 0, 1, 2, 0)


def test_frontier_seed_listed_twice_and_long_chain(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(12)]
    visited, counts = frontier.expand(seeds(spark, "p0", "p0"), edges(spark, *chain))
    assert {r["url"]: r["wave"] for r in visited.collect()} == {f"p{i}": i for i in range(13)}
    assert tuple(counts.first()) == (14, 0, 12, 1, 0)


def test_frontier_far_waves_like_near_ones(spark):
    grid = [(f"g{x},{y}", to) for x in range(6) for y in range(6) for to in (f"g{x + 1},{y}", f"g{x},{y + 1}", f"g{x // 2},{y}")]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(24)] + [("c24", "c0"), ("c7", "g3,3"), ("c20", "c20"), ("c23", "away"), ("lost", "c10")]
    nulls = [("c5", None), ("c5", None), ("c21", None), (None, "c3"), ("g8,8", None), ("c2", "c3")]
    links = edges(spark, *grid, *chain, *nulls)
    plain, known = frontier.expand(seeds(spark, "c0", "g0,0", "g0,0"), links, near_waves=10**6)
    for near in (1, 5):
        visited, counts = frontier.expand(seeds(spark, "c0", "g0,0", "g0,0"), links, near_waves=near)
        assert visited.dtypes == plain.dtypes
        assert sorted(map(repr, visited.collect())) == sorted(map(repr, plain.collect()))
        assert counts.collect() == known.collect()


def test_frontier_takes_fewer_steps_than_waves(spark):
    context, chain = spark.sparkContext, [(f"p{i}", f"p{i + 1}") for i in range(150)]
    context.setJobGroup("long chain", "long chain")
    visited, _ = frontier.expand(seeds(spark, "p0"), edges(spark, *chain))
    assert {r["url"]: r["wave"] for r in visited.collect()} == {f"p{i}": i for i in range(151)}
    # A wave takes several jobs.
    assert len(context.statusTracker().getJobIdsForGroup("long chain")) < 250
    context.setLocalProperty("spark.jobGroup.id", None)


def test_frontier_limit(spark):
    star = [("a", f"b{i}") for i in range(9)]
    visited, counts = frontier.expand(seeds(spark, "a"), edges(spark, *star), limit=4)
    assert sorted(r["url"] for r in visited.collect()) == ["a", "b0", "b1", "b2"]
    assert tuple(counts.first()) == (4, 0, 3, 0, 6)
    assert frontier.expand(seeds(spark), edges(spark, *star))[0].count() == 0


def test_seed_batch(spark):
    kept = seeds(spark, "s")
    pick = lambda fn, limit=None: sorted(r["url"] for r in frontier.seed_batch(spark, kept, fn, limit).collect())
    assert pick(None) == ["s"] and pick(lambda s: None) == ["s"]
    assert pick(lambda s: seeds(s)) == [] and pick(lambda s: seeds(s, "x", "y")) == ["x", "y"]
    assert pick(lambda s: seeds(s, "x", None)) == ["s"] and pick(lambda s: seeds(s, "x", "y"), 1) == ["s"]
    assert pick(lambda s: s.range(2)) == ["s"]


def test_retry_grid(spark):
    rows = [("u", a * 2 + p, f"p{p}", 500) for a in range(3) for p in range(2)] + [("v", 1, "p0", 500), ("v", 2, "p1", 200), ("v", 3, "p0", 200)]
    log = spark.createDataFrame(rows, "url string, attempt int, proxy string, status int")
    got = {r["url"]: (r["attempts"], r["outcome"], r["attempt"], r["proxy"]) for r in frontier.first_success(
        log, ["url"], ["attempt"], F.col("status") == 200, ["proxy"]).collect()}
    assert got == {"u": (6, "exhausted", None, None), "v": (3, "ok", 2, "p1")}


def test_streaks(spark):
    log = spark.createDataFrame([(i, "j", c == "x") for i, c in enumerate("xx.x..xxx")], "seq int, job string, bad boolean")
    got = signals.failure_streaks(log, "job", ["seq"], F.col("bad"))
    assert [r["streak"] for r in got.orderBy("seq").collect()] == [1, 2, 0, 1, 0, 0, 1, 2, 3]


def test_heartbeat(spark):
    ticks = spark.createDataFrame([(t, "j") for t in (0, 5, 86_400, 90_000, 172_799, 172_800)], "t bigint, job string")
    got = signals.heartbeats(ticks, "job", ["t"], "t")
    assert [r["t"] for r in got.where("beat").orderBy("t").collect()] == [86_400, 172_800]


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5)], "id bigint, name string, value double")
    got = tables.query(spark, "SELECT name FROM t WHERE value > ? AND ? IS NULL AND id < ?", [2.0, None, 10], t=base)
    assert sorted(r["name"] for r in got.collect()) == ["b", "c"]
    after, changed = tables.update_where(base, F.col("name") == "b", {"value": F.lit(9.0)})
    assert changed.collect() == [(2, "b", 9.0)] and after.count() == 3
    left, gone = tables.delete_where(after, F.col("value").isNull() | (F.col("id") == 1))
    assert left.count() == 2 and [r["id"] for r in gone.collect()] == [1]
    changes = spark.createDataFrame([(3, "x", 0.0, 1), (3, "y", 0.0, 2), (4, "z", 0.0, 1)], "id bigint, name string, value double, seq int")
    assert sorted((r["id"], r["name"]) for r in tables.upsert(base, changes, ["id"], "seq").collect()) == [(1, "a"), (2, "b"), (3, "y"), (4, "z")]
    ignored = tables.insert_or_ignore(base, changes.drop("seq"), ["id"], ["name"])
    assert sorted((r["id"], r["name"]) for r in ignored.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "z")]
    with pytest.raises(Exception):
        tables.query(spark, "SELECT nothing FROM t", t=base)


def test_spec_checks(spark):
    good = JobSpec("Good", "https://x/", "p", ["t:p"], search_fields=[" t "], hash_fields=["t"])
    bad = JobSpec(" ", "x", "", [FieldSpec(" t", "p"), FieldSpec("t", " "), FieldSpec("", "p")], search_fields=["no"], interval=0, workers=0,
                  webhook={"url": "h"}, proxy={"urls": []}, urls=[])
    off = JobSpec("good!", "https://x/", "p", ["t:p"], webhook={"enabled": False, "url": ""}, proxy={"enabled": False, "urls": ["x"]})
    specs = spec_table(spark, [good, bad, off])
    found = {(r["problem"], r["detail"]) for r in quality.spec_violations(specs).collect()}
    assert found == {
        ("name is blank", ""), ("url is not absolute", "x"), ("selector is blank", ""), ("interval is not positive", ""), ("workers is not positive", ""),
        ("urls is empty", ""), ("webhook url is bad", "h"), ("proxy has no urls", ""), ("field name is blank", ""), ("field selector is blank", "t"),
        ("field name is repeated", "t"), ("search field is unknown", "no"),
    }
    assert sorted(r["name"] for r in quality.valid_specs(specs).collect()) == ["Good", "good!"]
    assert [tuple(r) for r in quality.set_violations(specs).collect()] == [("id is repeated", "good", 2)]


def test_body_limit(spark):
    rows = spark.createDataFrame([(1, "é" * 5), (2, "é" * 5 + "x"), (3, "")], "page_id int, html string")
    assert [r["page_id"] for r in accepted(rows, limit=10).orderBy("page_id").collect()] == [1, 3]
    bad = quarantined(rows, limit=10).first()
    assert (bad["page_id"], bad["error_kind"]) == (2, "size")
    broken = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"\xff"))], "page_id int, html binary")
    assert [r["error_kind"] for r in quarantined(broken).collect()] == ["encoding"]


def test_attempts(spark):
    log = spark.createDataFrame([("u", 204, None), ("u", 404, None), ("u", None, "boom")], "url string, status int, error string")
    rows = attempts(log).collect()
    assert [r["ok"] for r in rows] == [True, False, False] and [r["response"] is None for r in rows] == [False, False, True]
    assert filters.response_gate(attempts(log)).count() == 0


def test_files(spark):
    base = scratch(spark)
    assert files.read_file(spark, f"{base}/none.csv", "a int").collect() == []
    assert files.read_file(spark, f"{base}/none.txt").columns == ["value"]
    for path in ("x.exe", "x"):
        with pytest.raises(ValueError):
            files.read_file(spark, path)
    with pytest.raises(ValueError):
        files.read_binary(spark, base, ["exe"])
    lines = spark.createDataFrame([("hello",)], "value string")
    files.write_file(lines, f"{base}/run.log", stamp=True)
    files.write_file(lines, f"{base}/run.log")
    logged = sorted(r["value"] for r in files.read_file(spark, f"{base}/run.log").collect())
    assert logged[1] == "hello" and logged[0].endswith("Z] hello")
    whole, odd = files.split_problems(files.json_intake(spark.createDataFrame([('{"a": [1]}',), ("{",), ("null",)], "t string"), "t"))
    assert whole.count() == 2 and [r["problem"] for r in odd.collect()] == ["not valid JSON"]


def test_item_filters(spark):
    rows = [("Rust dev", "ok co", "from 120 to 150"), ("Rust intern", "ok co", ""), ("Go dev", "SPAM corp", ""), ("Cook", "ok co", ""), ("go dev", "other", "none")]
    items = spark.createDataFrame(rows, "title string, company string, salary string")
    blocked = spark.createDataFrame([("spam corp",), ("Scam Inc",)], "name string")
    title = F.lower("title")
    kept = filters.not_blocked(items, blocked, F.col("company"), "name").where(
        ~F.contains(title, F.lit("intern")) & filters.has_any(title, ["rust", "go", "python"])
    )
    assert sorted(tuple(r) for r in kept.select("title", filters.salary_text(F.col("salary"))).collect()) == [("Rust dev", "$120k+"), ("go dev", "none")]
    prices = spark.createDataFrame([("$50,001",), ("50000",), ("call",), ("",)], "p string")
    assert [r["p"] for r in prices.where(filters.under_ceiling(F.col("p"), 50000)).collect()] == ["50000", "call", ""]
    assert [r["p"] for r in prices.where(filters.first_number_under(F.col("p"), 1000)).collect()] == ["$50,001", "call", ""]


def test_slices_are_written_by_many_tasks_and_read_as_one_batch_each(spark, tmp_path):
    from pagewatch.plans.catalog_streams import in_time_slices

    rows, seen = spark.range(0, 90, 1, 6), {}

    def run(stream):
        def step(batch, batch_id):
            seen[batch_id] = sorted(r["id"] for r in batch.collect())

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()

    in_time_slices(rows, F.col("id") % 3, str(tmp_path), 3, run)
    assert seen == {n: list(range(n, 90, 3)) for n in range(3)}
    assert len(list((tmp_path / "slices").glob("*.parquet"))) == 18
