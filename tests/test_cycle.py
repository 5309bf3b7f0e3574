from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.operators.extract import preview, routed
from pagewatch.plans.cycle import Cycle, Hooks
from pagewatch.session import scratch
from pagewatch.sources.sinks import RecordStore
from pagewatch.spec import JobSpec, Notification
from pagewatch.streaming.monitor import monitor, stream_new_items, stream_pages

SPEC = JobSpec("Shop", "https://s.example.com/", ".c", ["t:h2", "l:a@href"], hash_fields=["t"])


def page(*titles):
    return "".join(f"<div class=c><h2>{t}</h2><a href=/{t}>x</a></div>" for t in titles)


def pages(spark, *rows):
    return spark.createDataFrame([(i, f"https://s.example.com/{i}", b) for i, b in enumerate(rows)], "page_id bigint, url string, html string")


def titles(store):
    return sorted((r["batch_id"], r["fields"]["t"], r["page_id"]) for r in store.records().collect())


def test_only_new_items_are_stored(spark):
    store = RecordStore(spark, scratch(spark))
    cycle = Cycle(SPEC, store)
    first = cycle.run(pages(spark, page("a", "b"), page("b", "c")), 0).first()
    assert (first["selector_matches"], first["kept"], first["new"], first["diagnosis"]) == (4, 4, 3, "ok")
    again = cycle.run(pages(spark, page("a", "b"), page("b", "c")), 1).first()
    assert (again["new"], again["diagnosis"]) == (0, "nothing_new")
    cycle.run(pages(spark, page("c", "d")), 2)
    cycle.run(pages(spark, page("c", "d")), 2)
    assert titles(store) == [(0, "a", 0), (0, "b", 0), (0, "c", 1), (2, "d", 0)]


def test_outcomes_and_pushes_are_counted(spark):
    """One page answered with 200 and nine with 503, one whose fetch failed, one without items; pushes of each kind."""
    rows = pages(spark, page("a", "b"), *["<p>busy</p>"] * 9, "", "<p>x</p>").withColumns({
        "status": F.when(F.col("page_id").between(1, 9), 503).otherwise(200),
        "error": F.when(F.col("page_id") == 10, "timed out"),
    })
    base = scratch(spark)

    def push(items):
        titles = F.element_at("fields", F.lit("t"))  # a and b
        links = items.select(F.concat(F.lit("https://s.example.com/"), titles).alias("url"))
        others = spark.createDataFrame([("https://s.example.com/a",), ("https://s.example.com/0",), (None,)], "url string")
        return links.union(others)

    counts = Cycle(SPEC, RecordStore(spark, base), Hooks(push=push)).run(rows, 0).first()
    assert counts["outcomes"] == {"ok": 1, "http_error": 9, "fetch": 1, "selector_matched_nothing": 1}
    assert sum(counts["outcomes"].values()) == counts["processed"] == 12 and counts["failed"] == 1
    assert (counts["pushed"], counts["duplicates"]) == (2, 2)
    assert sorted(r["url"] for r in spark.read.json(f"{base}/pushed/batch_id=0").collect()) == ["https://s.example.com/a", "https://s.example.com/b"]

    def boom(items):
        raise RuntimeError("boom")

    counts = Cycle(SPEC, RecordStore(spark, scratch(spark)), Hooks(push=boom)).run(pages(spark, page("a")), 0).first()
    assert (counts["pushed"], counts["duplicates"], counts["new"], counts["outcomes"]) == (0, 0, 1, {"ok": 1})


def test_permuted_input_gives_the_same_hashes(spark):
    stores = [RecordStore(spark, scratch(spark)) for _ in range(2)]
    bodies = [page("a", "b"), page("b", "c"), page("c", "a")]
    Cycle(SPEC, stores[0]).run(pages(spark, *bodies), 0)
    Cycle(SPEC, stores[1]).run(pages(spark, *reversed(bodies)).repartition(3), 0)
    hashes = [{r["hash"] for r in s.records().collect()} for s in stores]
    assert hashes[0] == hashes[1] and len(hashes[0]) == 3


def test_job_scope(spark):
    store = RecordStore(spark, scratch(spark))
    Cycle(SPEC, store).run(pages(spark, page("a")), 0)
    other = JobSpec("Other", "https://o/", ".c", SPEC.fields, hash_fields=["t"])
    assert Cycle(other, store).run(pages(spark, page("a")), 1).first()["new"] == 0
    assert Cycle(other, store, scope="job").run(pages(spark, page("a")), 2).first()["new"] == 1


def test_diagnosis(spark):
    run = lambda spec, body: Cycle(spec, RecordStore(spark, scratch(spark))).run(pages(spark, body), 0).first()["diagnosis"]
    assert run(SPEC, "<p>x</p>") == "selector_matched_nothing"
    assert run(JobSpec("K", "https://s/", ".c", ["t:h2"], keywords=["zzz"]), page("a")) == "no_keyword_hit"


def test_stage_order_and_failing_hooks(spark):
    calls = []

    def noted(name, change=lambda rows: rows):
        def stage(rows):
            calls.append(name)
            return change(rows)

        return stage

    def broken(rows):
        calls.append("after_extract")
        raise RuntimeError("boom")

    hooks = Hooks(
        before_fetch=noted("before_fetch"), after_fetch=noted("after_fetch"), after_extract=broken,
        filter_item=noted("filter_item", lambda rows: rows.where(F.col("fields")["t"] != "b")), before_store=noted("before_store"),
        before_notify=noted("before_notify", lambda rows: rows.limit(0)), before_webhook=noted("before_webhook"),
    )
    spec = JobSpec("Shop", "https://s/", ".c", ["t:h2"], notification=Notification(), webhook={"url": "https://h/"}, debug=True)
    base = scratch(spark)
    counts = Cycle(spec, RecordStore(spark, base), hooks).run(pages(spark, page("a", "b", "c")), 0).first()
    assert calls == ["before_fetch", "after_fetch", "after_extract", "filter_item", "before_store", "before_notify", "before_webhook"]
    assert (counts["kept"], counts["new"], counts["notified"]) == (2, 2, 0)
    assert spark.read.text(f"{base}/webhooks/batch_id=0").count() == 1
    assert spark.read.text(f"{base}/debug/batch_id=0").count() == 2


def test_failing_extraction_and_error_callback(spark):
    def boom(rows):
        raise RuntimeError("boom")

    store = RecordStore(spark, scratch(spark))
    assert Cycle(SPEC, store, Hooks(override_extract=boom)).run(pages(spark, page("a")), 0).first()["new"] == 0
    seen = []
    hooks = Hooks(on_error=seen.append, on_finally=lambda: seen.append("end"))
    assert Cycle(SPEC, store, hooks).run(spark.range(1), 1) is None
    assert len(seen) == 2 and seen[1] == "end"


def test_batch_equals_stream(spark):
    base = scratch(spark)
    rows = pages(spark, page("a", "b"), page("b", "c"), page("d", "a"), page("e"))
    for number in range(4):
        rows.where(F.col("page_id") == number).coalesce(1).write.mode("append").parquet(f"{base}/in")
    streamed, batch = RecordStore(spark, f"{base}/s"), RecordStore(spark, f"{base}/b")
    monitor(stream_pages(spark, f"{base}/in", rows.schema, 1), Cycle(SPEC, streamed), f"{base}/progress").awaitTermination()
    Cycle(SPEC, batch).run(rows, 0)
    assert {r["hash"] for r in streamed.records().collect()} == {r["hash"] for r in batch.records().collect()}
    # Nothing new in the folder: a restart from the same progress stores nothing again.
    monitor(stream_pages(spark, f"{base}/in", rows.schema, 1), Cycle(SPEC, streamed), f"{base}/progress").awaitTermination()
    assert streamed.records().count() == 5


def test_stream_dedup_with_a_horizon_plans(spark):
    base = scratch(spark)
    rows = pages(spark, page("a", "a")).withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(f"{base}/in")
    items = stream_new_items(stream_pages(spark, f"{base}/in", rows.schema), SPEC, "seen_at", "1 day")
    writer = items.select("hash").writeStream.format("parquet").option("checkpointLocation", f"{base}/p").trigger(availableNow=True)
    writer.start(f"{base}/out").awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 1


def test_preview_and_routing(spark):
    rows = pages(spark, page("a"), page("b"))
    assert preview(rows, SPEC).select("parent_html").count() == 1
    listed = JobSpec("L", "https://s.example.com/0", ".c", ["t:h2"], urls=["https://s.example.com/1"])
    assert [r["page_id"] for r in routed(rows, listed).collect()] == [1]
    assert [r["page_id"] for r in routed(rows, JobSpec("L", "https://s.example.com/0", ".c", ["t:h2"])).collect()] == [0]


def test_keywords_come_before_hooks_and_hook_fields_are_searched(spark):
    spec = JobSpec("K", "https://s/", ".c", ["t:h2"], keywords=["red"])
    store = RecordStore(spark, scratch(spark))
    hooks = Hooks(filter_item=lambda rows: rows)
    Cycle(spec, store, hooks).run(pages(spark, page("red a", "blue b")), 0)
    assert [(r["fields"]["t"], r["match_key"]) for r in store.records().collect()] == [("red a", ["red"])]
    added = lambda rows: rows.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("colour"), F.lit("Red"))))
    made = lambda rows: rows.select("page_id", F.lit(0).alias("item_ord"), F.create_map(F.lit("own"), F.lit("so red")).alias("fields"))
    for hooks in (Hooks(override_extract=made), Hooks(override_extract=lambda rows: added(made(rows)))):
        store = RecordStore(spark, scratch(spark))
        assert Cycle(spec, store, hooks).run(pages(spark, page("x")), 0).first()["new"] == 1


def test_failing_filter_and_fetch(spark):
    def boom(rows):
        raise RuntimeError("boom")

    spec = JobSpec("K", "https://s/", ".c", ["t:h2"], keywords=["red"])
    store = RecordStore(spark, scratch(spark))
    Cycle(spec, store, Hooks(filter_item=boom)).run(pages(spark, page("red a", "blue b")), 0)
    assert [r["match_key"] for r in store.records().collect()] == [["red"]]
    base = scratch(spark)
    counts = Cycle(SPEC, RecordStore(spark, base), Hooks(override_fetch=boom)).run(pages(spark, page("a"), page("b")), 0).first()
    assert (counts["processed"], counts["failed"], counts["new"]) == (2, 2, 0)
    assert {r["error"] for r in spark.read.json(f"{base}/rejected/batch_id=0").collect()} == {"override_fetch failed: boom"}


def test_record_times_are_the_clock_and_survive_a_repeat(spark):
    import time

    store, began = RecordStore(spark, scratch(spark)), time.time_ns()
    Cycle(SPEC, store).run(pages(spark, page("a", "b")), 3)
    first = {r["ts_ns"] for r in store.records().collect()}
    Cycle(SPEC, store).run(pages(spark, page("a", "b")), 3)
    assert {r["ts_ns"] for r in store.records().collect()} == first and len(first) == 1 and began <= first.pop() <= time.time_ns()


def test_job_ids_are_equal_in_both_forms(spark):
    from pagewatch.functions.text import job_id

    names = ["हिन्दी समाचार", "Shop 24/7", "ÅÄÖ!", "__x__", "日本 ٣"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", job_id(F.col("name")).alias("id")).collect()
    assert all(JobSpec(r["name"], "u", ".c", ["t:h2"]).job_id == r["id"] for r in rows)
