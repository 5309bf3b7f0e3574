"""Many jobs of a specification table over one reading of the pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewatch.operators import jobs as many
from pagewatch.operators.extract import extract_items
from pagewatch.operators.dedup import hash_items
from pagewatch.plans.many_jobs import ManyJobs
from pagewatch.sources.sinks import RecordStore
from pagewatch.spec import JobSpec, spec_table

PAGES = [
    (1, "https://a/1", "<ul><li><a href='/x'>The first</a></li><li><a href='/y'>KKelvin</a></li></ul><h1>Top</h1>"),
    (2, "https://a/2", "<ul><li><a href='/x'>The first</a></li><li>no link</li></ul><h1> </h1>"),
    (3, "https://b/1", "<p>nothing"),
    (4, None, "<li><a>nowhere</a></li>"),
]
ALL = ["https://a/1", "https://a/2", "https://b/1"]
JOBS = [
    JobSpec("Links A", "https://a/1", "li", ["text:a", "link:a@href"], keywords=[" THE "]),
    JobSpec("Links All", "https://a/1", "li", ["text:a", "link:a@href"], urls=ALL, hash_fields=[" ", "text "]),
    JobSpec("Kelvin", "https://a/1", "li", ["text:a", "link:a@href"], keywords=["kk", "kK"], search_fields=["text", "ghost"]),
    JobSpec("Blank words", "https://a/1", "li", ["text:a", "link:a@href"], keywords=[" "]),
    JobSpec("Heads", "https://b/1", "h1", ["text:"], urls=ALL + ALL),
    JobSpec("Off", "https://a/1", "li", ["text:a"], enabled=False),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


def told(rows):
    columns = ["job_id", "page_id", "item_ord", "fields", "matches", "hash", "selector_matches"]
    return sorted((tuple(map(str, r)) for r in rows.select(columns).collect()))


def test_rows_are_those_of_each_job_alone(spark, pages):
    together = told(many.extract_jobs(pages, spec_table(spark, JOBS)))
    alone = []
    for spec in JOBS[:-1]:
        own = pages.where(F.col("url").isin(spec.targets))
        alone += told(hash_items(extract_items(own, spec), spec))
    assert together == sorted(alone) and together


def test_one_parse_and_a_plan_that_does_not_grow_with_the_jobs(spark, pages):
    def plan(jobs):
        return many.extract_jobs(pages, spec_table(spark, jobs))._jdf.queryExecution().optimizedPlan().toString()

    few = plan(JOBS[:1])
    lots = plan([JobSpec(f"Job {n}", "https://a/1", "li", ["text:a", "link:a@href"], keywords=[f"word {n}"]) for n in range(300)])
    assert few.count("\n") == lots.count("\n")
    assert plan(JOBS).count("ArrowEvalPython") == few.count("ArrowEvalPython")


def test_layouts_beyond_one_reading(spark, pages, monkeypatch):
    whole = told(many.extract_jobs(pages, spec_table(spark, JOBS)))
    monkeypatch.setattr(many, "LAYOUTS_AT_ONCE", 1)
    assert told(many.extract_jobs(pages, spec_table(spark, JOBS))) == whole


def test_an_address_that_very_many_jobs_want(spark, pages):
    jobs = [JobSpec(f"Job {n}", "https://a/1", "li", ["text:a"]) for n in range(500)]
    assert many.extract_jobs(pages, spec_table(spark, jobs)).count() == 1000


def test_no_job_and_no_page(spark, pages):
    assert many.extract_jobs(pages, spec_table(spark, [JOBS[-1]])).count() == 0
    assert many.extract_jobs(pages.limit(0), spec_table(spark, JOBS)).count() == 0


def test_counts_of_every_job(spark, pages, tmp_path):
    log = pages.withColumns({"status": F.when(F.col("page_id") == 2, 503).otherwise(200), "error": F.when(F.col("page_id") == 3, "connection reset")})
    jobs = ManyJobs(spec_table(spark, [JOBS[0], JOBS[1], JobSpec("Away", "https://c/", "li", ["text:a"])]), RecordStore(spark, str(tmp_path)))
    counts = {r["job_id"]: r for r in jobs.run(log, 0).collect()}
    assert counts["links_all"]["pages"] == 3 and counts["links_all"]["failed"] == 1
    # Both jobs find the two links of the first page; one item belongs to the first job by its id.
    assert (counts["links_a"]["kept"], counts["links_a"]["new"]) == (1, 1)
    assert counts["links_all"]["selector_matches"] == 4 and counts["away"]["diagnosis"] == "no_pages"
    again = {r["job_id"]: r for r in jobs.run(log, 1).collect()}
    assert sum(r["new"] for r in again.values()) == 0 and again["links_a"]["diagnosis"] == "nothing_new"
    assert spark.read.json(f"{tmp_path}/rejected/batch_id=0").count() == 1
