"""Queries over url batches and names: frontiers, lanes, pools, retries, ids, labels and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.functions import text
from pagewatch.operators import filters, frontier
from pagewatch.operators.extract import page_links, page_titles
from pagewatch.operators.ordered import numbered
from pagewatch.operators.quality import union_specs
from pagewatch.plans import sql
from pagewatch.plans.registry import query
from pagewatch.plans.samples import ATTEMPTS_SQL, TARGETS_SQL, event_attempts, string_map, targets
from pagewatch.sources import files
from pagewatch.sources.pages import scan, scan_pages


def page_graph(spark: SparkSession, folder: str) -> DataFrame:
    """links(src, dst, pos): two targets per page, by page number, as in the SQL."""
    pages = scan(spark, folder, "pages").select("page_id")
    n = pages.count()
    key = F.col("page_id")
    pairs = F.array(F.pmod(7 * key + 3, F.lit(n)), F.pmod(3 * key + 1, F.lit(n)))
    return pages.select(key.alias("src"), F.posexplode(pairs).alias("pos", "dst")).select(
        F.col("src").cast("string"), F.col("dst").cast("string"), "pos"
    )


def first_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page with the lowest number, and the one with the highest listed twice."""
    ends = scan(spark, folder, "pages").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    return ends.select(F.explode(F.array(*[F.col(c).cast("string") for c in ("low", "high", "high")])).alias("url"))


REACHED = f"""
    links AS ({sql.links()}),
    seeds AS (SELECT min(page_id) AS url FROM pages UNION ALL SELECT max(page_id) FROM pages UNION ALL SELECT max(page_id) FROM pages),
    reach AS (
        SELECT DISTINCT url, 0 AS wave FROM seeds
        UNION
        SELECT l.dst, r.wave + 1 FROM reach r JOIN links l ON l.src = r.url WHERE r.wave < 40),
    visited AS (SELECT url, min(wave) AS wave FROM reach GROUP BY url)
"""


@query("g01_frontier_waves", f"WITH RECURSIVE {REACHED} SELECT CAST(url AS VARCHAR) AS url, CAST(wave AS INTEGER) AS wave FROM visited")
def frontier_waves(spark: SparkSession, folder: str) -> DataFrame:
    visited, _ = frontier.expand(first_pages(spark, folder), page_graph(spark, folder))
    return visited.select("url", F.col("wave").cast("int").alias("wave"))


@query("g01_frontier_stats", f"""
    WITH RECURSIVE {REACHED},
    work AS (SELECT url FROM seeds UNION ALL SELECT url FROM visited WHERE wave > 0)
    SELECT count(*) AS processed, CAST(0 AS BIGINT) AS failed, (SELECT count(*) FROM visited WHERE wave > 0) AS pushed,
           (SELECT count(*) FROM work w JOIN links l ON l.src = w.url) - (SELECT count(*) FROM visited WHERE wave > 0) AS duplicates,
           CAST(0 AS BIGINT) AS rejected FROM work
""")
def frontier_stats(spark: SparkSession, folder: str) -> DataFrame:
    _, counts = frontier.expand(first_pages(spark, folder), page_graph(spark, folder))
    return counts


@query("g01_parsed_links", f"""
    WITH RECURSIVE links AS (SELECT url AS src, {sql.ORIGIN} || {sql.clean('href')} AS dst FROM ({sql.LIST_ITEMS})),
    reach AS (
        SELECT DISTINCT url, 0 AS wave FROM pages
        UNION
        SELECT l.dst, r.wave + 1 FROM reach r JOIN links l ON l.src = r.url WHERE r.wave < 40)
    SELECT url, CAST(min(wave) AS INTEGER) AS wave FROM reach GROUP BY url
""")
def parsed_links(spark: SparkSession, folder: str) -> DataFrame:
    """The frontier over the links of the parsed pages, from the pages themselves."""
    pages = scan_pages(spark, folder)
    visited, _ = frontier.expand(pages.select("url"), page_links(pages, "a"))
    return visited.select("url", F.col("wave").cast("int").alias("wave"))


@query("g02_dynamic_batch", f"""
    SELECT 'computed' AS how, url FROM ({TARGETS_SQL}) WHERE 2100 - last_check >= interval_sec
    UNION ALL SELECT 'seed kept', 'https://t.example.com/' || c_custkey FROM customer
""")
def dynamic_batch(spark: SparkSession, folder: str) -> DataFrame:
    seeds = targets(spark, folder).select("url")

    def due(session: SparkSession) -> DataFrame:
        return targets(session, folder).where(2100 - F.col("last_check") >= F.col("interval_sec")).select("url")

    def broken(session: SparkSession) -> DataFrame:
        return targets(session, folder).select(F.when(F.col("segment") != "BUILDING", F.col("url")).alias("url"))

    computed = frontier.seed_batch(spark, seeds, due, limit=None).select(F.lit("computed").alias("how"), "url")
    kept = frontier.seed_batch(spark, seeds, broken, limit=None).select(F.lit("seed kept").alias("how"), "url")
    return computed.unionByName(kept)


@query("w05_pool_assignment", """
    SELECT c_custkey, 'p0' AS sticky, 'p' || (row_number() OVER (ORDER BY c_custkey) - 1) % 3 AS in_turn, CAST(NULL AS VARCHAR) AS disabled, true AS random_is_member FROM customer
""")
def pool_assignment(spark: SparkSession, folder: str) -> DataFrame:
    pool = ["p0", "p1", "p2"]
    rows = scan(spark, folder, "customer").select("c_custkey")
    order = ["c_custkey"]
    rows = frontier.assign_pool(rows, pool, "Sticky", order).withColumnRenamed("proxy", "sticky")
    rows = frontier.assign_pool(rows, pool, "RoundRobin", order).withColumnRenamed("proxy", "in_turn")
    rows = frontier.assign_pool(rows, pool, "Sticky", order, enabled=False).withColumnRenamed("proxy", "disabled")
    rows = frontier.assign_pool(rows, pool, "Random", order, seed=7)
    return rows.withColumn("random_is_member", F.col("proxy").isin(pool)).drop("proxy")


@query("w06_worker_lanes", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 8 + 1 AS lane FROM orders")
def worker_lanes(spark: SparkSession, folder: str) -> DataFrame:
    return frontier.lanes(scan(spark, folder, "orders").select("o_orderkey"), 8, ["o_orderkey"], group_rows=4000)


@query("l05_first_success", f"""
    SELECT url, count(*) AS attempts, CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'exhausted' ELSE 'ok' END AS outcome,
           min(attempt_id) FILTER (WHERE ok) AS attempt_id, arg_min(status, attempt_id) FILTER (WHERE ok) AS status
    FROM (SELECT *, error IS NULL AND status = 200 AND time_ms < 5000 AS ok FROM ({ATTEMPTS_SQL})) GROUP BY url
""")
def first_success(spark: SparkSession, folder: str) -> DataFrame:
    log = event_attempts(spark, folder)
    ok = F.coalesce(F.col("error").isNull() & (F.col("status") == 200) & (F.col("time_ms") < 5000), F.lit(False))
    return frontier.first_success(log, ["url"], ["attempt_id"], ok, ["status"])


@query("l06_claim_due", f"""
    SELECT id, (row_number() OVER (ORDER BY last_check, id) - 1) % 4 + 1 AS lane FROM ({TARGETS_SQL}) WHERE 2100 - last_check >= interval_sec
""")
def claim_due(spark: SparkSession, folder: str) -> DataFrame:
    rows = filters.due(targets(spark, folder), F.lit(2100)).select("id", "last_check")
    return frontier.lanes(rows, 4, ["last_check", "id"]).select("id", "lane")


@query("l07_numbered_pages", """
    SELECT page_id, CAST(n AS INTEGER) AS page, url || CASE WHEN contains(url, '?') THEN '&page=' ELSE '?page=' END || n AS page_url,
           CAST(page_id % 5 + 1 AS BIGINT) AS page_of_run
    FROM pages, generate_series(1, 5) AS s(n)
""")
def numbered_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = scan(spark, folder, "pages").select("page_id", "url")
    rows = frontier.numbered_pages(pages, 5)
    return rows.select("page_id", "page", "page_url", frontier.page_of_run(F.col("page_id") + 1, 5).alias("page_of_run"))


@query("c01_job_id", r"""
    SELECT page_id, regexp_replace(lower(regexp_replace(title, '[^\p{L}\p{N}]', '_', 'g')), '^_+|_+$', '', 'g') AS job_id
    FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages)
""")
def job_id(spark: SparkSession, folder: str) -> DataFrame:
    return page_titles(scan(spark, folder, "pages")).select("page_id", text.job_id(F.col("title")).alias("job_id"))


@query("c04_label", """
    SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '_') || '_' || p_type || '__é', '_'),
           lambda p: upper(p[1:1]) || p[2:]), ' ') AS label FROM part
""")
def label(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_type"), F.lit("__é"))
    return scan(spark, folder, "part").select("p_partkey", text.label(name).alias("label"))


@query("c06_template_render", """
    SELECT p_partkey, p_name || ': ' || p_brand || ' {x y} ' || ' {' || p_type || '} é' AS line FROM part
""")
def template_render(spark: SparkSession, folder: str) -> DataFrame:
    fields = string_map(name=F.col("p_name"), brand=F.col("p_brand"))
    line = text.render("{name}: {brand} {x y} {gone} {{kind}} é", {"kind": F.col("p_type"), "name": F.lit("hidden")}, fields)
    return scan(spark, folder, "part").select("p_partkey", line.alias("line"))


QUERY_TAILS = ["a=1&b=%41+c", "q=%zz&&=x&solo", "u=%C3%A9&u=last", "bad=%E9&k%3D=v=w"]


@query("c07_url_parameters", f"""
    WITH given AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || tail AS url
                   FROM pages, (VALUES {', '.join(f"('{t}')" for t in QUERY_TAILS)}) AS t(tail)),
    pairs AS (
        SELECT page_id, url, unnest(p) AS pair, generate_subscripts(p, 1) AS pos
        FROM (SELECT page_id, url, string_split(url[strpos(url, '?') + 1:], '&') AS p FROM given)),
    cut AS (
        SELECT page_id, url, pos, CASE WHEN strpos(pair, '=') > 0 THEN pair[:strpos(pair, '=') - 1] ELSE pair END AS k,
               CASE WHEN strpos(pair, '=') > 0 THEN pair[strpos(pair, '=') + 1:] ELSE '' END AS v FROM pairs WHERE pair <> ''),
    decoded AS (
        SELECT page_id, url, pos, replace(k, '%3D', '=') AS key,
               CASE WHEN v = '%E9' THEN '' ELSE replace(replace(replace(v, '+', ' '), '%41', 'A'), '%C3%A9', 'é') END AS value FROM cut)
    SELECT page_id, key, value, count(*) AS n FROM (SELECT page_id, url, key, arg_max(value, pos) AS value FROM decoded GROUP BY page_id, url, key) GROUP BY page_id, key, value
""")
def url_parameters(spark: SparkSession, folder: str) -> DataFrame:
    tails = F.array(*[F.lit(t) for t in QUERY_TAILS])
    given = scan(spark, folder, "pages").select("page_id", "url", F.explode(tails).alias("tail"))
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), "tail")
    return frontier.url_parameters(given.select("page_id", url.alias("url")), ["page_id"]).groupBy("page_id", "key", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("c09_json_intake", """
    SELECT CASE WHEN event_type = 'error' THEN 'not valid JSON' END AS problem, count(*) AS n,
           CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS k
    FROM events GROUP BY problem
""")
def json_intake(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.replace("props", F.lit("}"), F.lit("]"))
    given = scan(spark, folder, "events").select(F.when(F.col("event_type") == "error", broken).otherwise(F.col("props")).alias("props"))
    taken = files.json_intake(given, "props")
    k = F.coalesce(F.try_variant_get("parsed", "$.k", "bigint"), F.lit(0))
    return taken.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("c10_json_lines", """
    SELECT '{"p_partkey":' || p_partkey || ',"p_name":' || CAST(to_json(p_name) AS VARCHAR) || ',"tags":' ||
           CASE WHEN p_type = 'PROMO' THEN '[]' ELSE '["' || p_type || '","' || p_brand || '"]' END || '}' AS value FROM part
""")
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.when(F.col("p_type") == "PROMO", F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    return files.json_lines(scan(spark, folder, "part").withColumn("tags", tags), ["p_partkey", "p_name", "tags"])


@query("c11_certificate_expiry", """
    SELECT o_orderkey, CAST(trunc((epoch(o_orderdate) - 900000000) / 86400) AS BIGINT) AS days_left,
           row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders
""")
def certificate_expiry(spark: SparkSession, folder: str) -> DataFrame:
    expires = text.wall_seconds(F.col("o_orderdate"))
    rows = scan(spark, folder, "orders").select("o_orderkey", "o_orderdate", text.days_left(expires, F.lit(900_000_000)).alias("days_left"))
    return numbered(rows, [], ["o_orderdate", "o_orderkey"], "place").drop("o_orderdate")


@query("u01_spec_union", """
    SELECT c_name AS name, 'file' AS source FROM customer UNION ALL SELECT s_name, 'folder' FROM supplier
""")
def spec_union(spark: SparkSession, folder: str) -> DataFrame:
    listed = scan(spark, folder, "customer").select(F.col("c_name").alias("name"), F.lit("file").alias("source"))
    found = scan(spark, folder, "supplier").select(F.lit("folder").alias("source"), F.col("s_name").alias("name"))
    return union_specs(listed, found)


@query("u02_seed_and_pushed", """
    WITH w AS (SELECT o_custkey AS url, 'seed' AS how FROM orders UNION ALL SELECT c_custkey, 'pushed' FROM customer)
    SELECT (SELECT count(*) FROM w) AS work, (SELECT count(DISTINCT url) FROM w) AS visited
""")
def seed_and_pushed(spark: SparkSession, folder: str) -> DataFrame:
    seeds = scan(spark, folder, "orders").select(F.col("o_custkey").alias("url"))
    pushed = scan(spark, folder, "customer").select(F.col("c_custkey").alias("url"))
    return seeds.union(pushed).agg(F.count(F.lit(1)).alias("work"), F.count_distinct("url").alias("visited"))
