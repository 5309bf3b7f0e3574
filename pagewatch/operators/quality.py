"""Checks on job specifications, as rows of what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions.text import is_blank, job_id, strip

ABSOLUTE_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+\S*$"


def _bad_url(value: Column) -> Column:
    return ~strip(value).rlike(ABSOLUTE_URL)


def _trimmed(values: Column) -> Column:
    return F.filter(F.transform(values, strip), lambda v: v != "")


def _nothing() -> Column:
    return F.array().cast("array<string>")


def spec_violations(specs: DataFrame) -> DataFrame:
    """(name, problem, detail): one row per problem of a specification."""
    names = F.transform("fields", lambda f: strip(f["name"]))
    repeated = F.filter(F.array_distinct(names), lambda n: (F.size(F.filter(names, lambda m: m == n)) > 1) & (n != ""))

    def when(problem: str, condition: Column, detail: Column | None = None) -> Column:
        about = F.lit("") if detail is None else F.coalesce(detail, F.lit(""))
        return F.when(condition, F.struct(F.lit(problem).alias("problem"), about.alias("detail")))

    def joined(values: Column) -> Column:
        return F.array_join(values, ", ")

    def unknown(column: str) -> Column:
        return F.array_except(_trimmed(F.coalesce(column, _nothing())), names)

    bad_urls = F.filter(F.coalesce("urls", _nothing()), lambda u: is_blank(u) | _bad_url(u))
    proxies = F.coalesce("proxy.urls", _nothing())
    bad_proxies = F.filter(proxies, lambda u: is_blank(u) | _bad_url(u))
    proxy_on = F.coalesce("proxy.enabled", F.lit(False))
    checks = [
        when("name is blank", is_blank(F.col("name"))),
        when("url is blank", is_blank(F.col("url"))),
        when("url is not absolute", ~is_blank(F.col("url")) & _bad_url(F.col("url")), F.col("url")),
        when("selector is blank", is_blank(F.col("selector"))),
        when("no fields", F.size(F.coalesce("fields", F.array().cast("array<struct<name:string,selector:string,attr:string>>"))) == 0),
        when("interval is not positive", F.col("interval") <= 0),
        when("workers is not positive", F.col("workers") <= 0),
        when("urls is empty", F.col("urls").isNotNull() & (F.size("urls") == 0)),
        when("urls holds a bad url", F.size(bad_urls) > 0, joined(bad_urls)),
        when("webhook url is bad", F.coalesce("webhook.enabled", F.lit(False)) & (is_blank(F.col("webhook.url")) | _bad_url(F.col("webhook.url"))),
             F.col("webhook.url")),
        when("proxy has no urls", proxy_on & (F.size(proxies) == 0)),
        when("proxy holds a bad url", proxy_on & (F.size(bad_proxies) > 0), joined(bad_proxies)),
        when("field name is blank", F.exists(names, lambda n: n == "")),
        when("field selector is blank", F.exists("fields", lambda f: is_blank(f["selector"]) & (strip(f["name"]) != "")),
             joined(F.transform(F.filter("fields", lambda f: is_blank(f["selector"])), lambda f: strip(f["name"])))),
        when("field name is repeated", F.size(repeated) > 0, joined(repeated)),
        when("search field is unknown", F.size(unknown("search_fields")) > 0, joined(unknown("search_fields"))),
        when("hash field is unknown", F.size(unknown("hash_fields")) > 0, joined(unknown("hash_fields"))),
    ]
    return specs.select("name", F.inline(F.array_compact(F.array(*checks))))


def set_violations(specs: DataFrame) -> DataFrame:
    """(problem, value, jobs): names and ids that more than one job has."""
    named = specs.select("name", job_id(F.col("name")).alias("id"))
    both = named.select(F.explode(F.array(
        F.struct(F.lit("name is repeated").alias("problem"), F.col("name").alias("value")),
        F.struct(F.lit("id is repeated").alias("problem"), F.col("id").alias("value")),
    )).alias("entry")).select("entry.*")
    return both.groupBy("problem", "value").agg(F.count(F.lit(1)).alias("jobs")).where("jobs > 1")


def union_specs(*sources: DataFrame) -> DataFrame:
    """Specifications of all sources together; the set checks apply to the union."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source)
    return out


def valid_specs(specs: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    return specs.join(spec_violations(specs).select(*keys).distinct(), list(keys), "left_anti")
