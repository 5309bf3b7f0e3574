"""Many jobs over one reading of the pages: the jobs are rows of the specification table (``spec.spec_table``).

Jobs that select the same containers and fields share a layout. A page is parsed once and read once per layout that any of
its jobs has; which jobs want its items is decided by a join afterwards, so neither the plan nor the parsed rows grow with
the number of jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pagewatch.functions.hashing import content_hash_by
from pagewatch.functions.matching import keyword_matches_by, lowered_words
from pagewatch.functions.text import job_id
from pagewatch.operators.extract import exploded, extract_layouts
from pagewatch.operators.filters import enabled
from pagewatch.session import durable, small
from pagewatch.spec import FieldSpec, JobSpec

# Layouts that one plan reads; with more the pages are parsed once per so many.
LAYOUTS_AT_ONCE = 24


def layouts_of(jobs: DataFrame) -> list[tuple[str, list[FieldSpec]]]:
    """The distinct layouts of the jobs, in order of their texts. They come to the driver, since the plan is made of them."""
    rows = jobs.select("selector", "fields").distinct().collect()
    named = [(row["selector"], [FieldSpec(f["name"], f["selector"], f["attr"]) for f in row["fields"]]) for row in rows]
    return sorted(named, key=lambda x: (x[0], [(f.name, f.selector, f.attr) for f in x[1]]))


def routing(jobs: DataFrame, layouts: list[tuple[str, list[FieldSpec]]]) -> DataFrame:
    """A row per job and address of its batch: ``job_id, url, layout`` and what the job does with the items."""
    spark = jobs.sparkSession
    rows = [(k, selector, [(f.name, f.selector, f.attr) for f in fields]) for k, (selector, fields) in enumerate(layouts)]
    numbers = spark.createDataFrame(rows, "layout int, selector string, fields array<struct<name:string,selector:string,attr:string>>")
    own = F.when(F.size("urls") > 0, F.col("urls")).otherwise(F.array("url"))
    targets = F.explode(F.array_distinct(own)).alias("url")
    return jobs.join(F.broadcast(numbers), ["selector", "fields"]).select(
        job_id(F.col("name")).alias("job_id"), targets, "layout", lowered_words(F.col("keywords")).alias("words"),
        (F.coalesce(F.size("keywords"), F.lit(0)) <= 0).alias("keeps_all"), F.transform("fields", lambda f: f["name"]).alias("names"),
        F.col("search_fields").alias("searched"), "hash_fields",
    )


def read_pages(pages: DataFrame, wanted: DataFrame, layouts: list[tuple[str, list[FieldSpec]]], body: str = "html") -> DataFrame:
    """The pages that some job wants, parsed: a row per page and layout with its ``items``.

    A page has as many numbers of layouts as there are, however many jobs want it. Where the addresses are too many to
    broadcast, the bodies move once."""
    numbers = small(wanted.groupBy("url").agg(F.collect_set("layout").alias("_layouts")))
    routed = numbers.join(pages, "url").select(*pages.columns, "_layouts")
    specs = [JobSpec(f"layout {k}", "", selector, fields) for k, (selector, fields) in enumerate(layouts)]
    parts = []
    for first in range(0, len(specs), LAYOUTS_AT_ONCE):
        here = F.transform(F.filter("_layouts", lambda k: k.between(first, first + LAYOUTS_AT_ONCE - 1)), lambda k: k - first)
        some = routed.withColumn("_layouts", here).where(F.size("_layouts") > 0)
        read = extract_layouts(some, specs[first : first + LAYOUTS_AT_ONCE], "_layouts", body)
        parts.append(read.withColumn("layout", F.col("layout") + first))
    return reduce(DataFrame.unionByName, parts)


def kept_items(read: DataFrame, wanted: DataFrame) -> DataFrame:
    """The items that each job keeps, with ``matches`` and, by the job's own fields, ``hash``.

    A layout's items meet the jobs of the page's address here. An address with very many jobs, or a page with very many
    items, is split by adaptive execution when the join shuffles."""
    items = exploded(read).join(small(wanted), ["url", "layout"])
    matches = keyword_matches_by(F.col("fields"), F.col("words"), F.col("names"), F.col("searched"))
    kept = items.withColumn("matches", matches).where(F.col("keeps_all") | (F.size("matches") > 0))
    hashed = kept.withColumn("hash", content_hash_by(F.col("fields"), F.col("hash_fields")))
    return hashed.drop("words", "keeps_all", "names", "searched", "hash_fields", "layout")


def extract_jobs(pages: DataFrame, jobs: DataFrame, body: str = "html") -> DataFrame:
    """Kept items of all enabled jobs over their own addresses: the columns of ``pages`` without the body, ``job_id``,
    ``item_ord``, ``fields``, ``matches``, ``hash`` and ``selector_matches``. No job, no items."""
    running = durable(enabled(jobs))
    layouts = layouts_of(running)
    if not layouts:
        return pages.limit(0).drop(body).selectExpr(
            "*", "0 AS selector_matches", "0 AS item_ord", "CAST(NULL AS map<string,string>) AS fields", "'' AS job_id",
            "CAST(NULL AS array<string>) AS matches", "'' AS hash",
        )
    wanted = routing(running, layouts)
    return kept_items(read_pages(pages, wanted, layouts, body), wanted)
