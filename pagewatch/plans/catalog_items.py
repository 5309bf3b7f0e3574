"""Queries over items: matching, filters, joins, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.functions import addresses, text
from pagewatch.functions.hashing import content_hash
from pagewatch.functions.matching import keyword_matches
from pagewatch.operators import dedup, digest, filters, frontier
from pagewatch.operators.extract import with_matches
from pagewatch.plans import sql
from pagewatch.plans.registry import query
from pagewatch.plans.samples import (
    ATTEMPTS_SQL, DOCUMENTS, TARGETS_SQL, document_items, event_attempts, string_map, targets,
)
from pagewatch.session import small
from pagewatch.sources.pages import attempts, scan

MATCHED = f"list_filter(['the', 'les', 'und', 'zzz'], lambda k: contains({sql.ascii_lower(chr(34) + 'text' + chr(34) + " || ' ' || lang")}, k))"


@query("f01_keyword_matches", f"SELECT doc_id, array_to_string({MATCHED}, '|') AS matches FROM documents")
def matches(spark: SparkSession, folder: str) -> DataFrame:
    found = keyword_matches(F.col("fields"), DOCUMENTS.keywords, DOCUMENTS.field_names, DOCUMENTS.search_fields)
    return document_items(spark, folder).select(F.col("page_id").alias("doc_id"), F.array_join(found, "|").alias("matches"))


@query("f02_keyword_filter", f"SELECT doc_id, CAST(len({MATCHED}) AS INTEGER) AS n FROM documents WHERE len({MATCHED}) > 0")
def keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    return with_matches(document_items(spark, folder), DOCUMENTS).select(F.col("page_id").alias("doc_id"), F.size("matches").alias("n"))


@query("f03_custom_filter", f"""
    SELECT doc_id, 'UND ' || lang AS lang, array_to_string(list_filter(['the', 'les', 'und', 'zzz'],
           lambda k: contains({sql.ascii_lower(chr(34) + 'text' + chr(34) + " || ' und ' || lang")}, k)), '|') AS matches
    FROM documents WHERE lang <> 'en'
""")
def custom_filter(spark: SparkSession, folder: str) -> DataFrame:
    def rewrite(items: DataFrame) -> DataFrame:
        lang = F.concat(F.lit("UND "), filters.field("lang"))
        return items.where(filters.field("lang") != "en").withColumn("fields", filters.with_field(F.col("fields"), "lang", lang))

    kept = filters.filtered(document_items(spark, folder), DOCUMENTS, rewrite)
    return kept.select(F.col("page_id").alias("doc_id"), filters.field("lang").alias("lang"), F.array_join("matches", "|").alias("matches"))


@query("f04_response_gate", f"SELECT attempt_id, job_id, status FROM ({ATTEMPTS_SQL}) WHERE error IS NULL AND status = 200")
def response_gate(spark: SparkSession, folder: str) -> DataFrame:
    return filters.response_gate(attempts(event_attempts(spark, folder))).select("attempt_id", "job_id", "status")


JOB_OFFERS_SQL = """
    SELECT c_custkey, n_name AS company, c_name || ' ' || c_mktsegment AS title, 'from ' || CAST(c_custkey AS VARCHAR) || ' a month' AS salary
    FROM customer JOIN nation ON n_nationkey = c_nationkey
"""


def job_offers(spark: SparkSession, folder: str) -> DataFrame:
    nations = small(scan(spark, folder, "nation"))
    rows = scan(spark, folder, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    fields = string_map(
        company=F.col("n_name"), title=F.concat_ws(" ", "c_name", "c_mktsegment"),
        salary=F.concat(F.lit("from "), F.col("c_custkey").cast("string"), F.lit(" a month")),
    )
    return rows.select("c_custkey", fields.alias("fields"))


@query("f05_blocklist_terms", f"""
    SELECT c_custkey, company, '$' || c_custkey || 'k+' AS salary FROM ({JOB_OFFERS_SQL})
    WHERE lower(company) NOT IN (SELECT lower(n_name) FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
      AND NOT contains(lower(title), 'furniture') AND (contains(lower(title), 'auto') OR contains(lower(title), 'build') OR contains(lower(title), '77'))
""")
def blocklist_terms(spark: SparkSession, folder: str) -> DataFrame:
    regions = small(scan(spark, folder, "region").where(F.col("r_name").isin("ASIA", "EUROPE")))
    blocked = scan(spark, folder, "nation").join(regions, F.col("r_regionkey") == F.col("n_regionkey"))
    title = F.lower(filters.field("title"))
    kept = filters.not_blocked(job_offers(spark, folder), blocked, filters.field("company"), "n_name")
    kept = kept.where(~F.contains(title, F.lit("furniture")) & filters.has_any(title, ["auto", "build", "77"]))
    return kept.select("c_custkey", filters.field("company").alias("company"), filters.salary_text(filters.field("salary")).alias("salary"))


PRICE_SQL = "CASE p_type WHEN 'PROMO' THEN 'call us' WHEN 'SMALL' THEN '' ELSE 'USD ' || printf('%.2f', p_retailprice) || ' only' END"


def price_text():
    return F.when(F.col("p_type") == "PROMO", "call us").when(F.col("p_type") == "SMALL", "").otherwise(
        F.format_string("USD %.2f only", "p_retailprice")
    )


@query("f06_price_ceiling", f"""
    SELECT p_partkey, {PRICE_SQL} AS price FROM part WHERE p_type IN ('PROMO', 'SMALL') OR p_retailprice <= 1000
""")
def price_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    parts = scan(spark, folder, "part").withColumn("price", price_text())
    return parts.where(filters.under_ceiling(F.col("price"), 1000.0)).select("p_partkey", "price")


@query("f07_first_number_ceiling", """
    SELECT p_partkey, upper(p_name) AS title FROM part
    WHERE p_name <> '' AND (p_type IN ('PROMO', 'SMALL') OR CAST(regexp_extract(printf('%.2f', p_retailprice), '[0-9]+', 0) AS DOUBLE) <= 950)
""")
def first_number_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    parts = scan(spark, folder, "part").withColumn("price", price_text())
    kept = parts.where(filters.titled(F.col("p_name")) & filters.first_number_under(F.col("price"), 950))
    return kept.select("p_partkey", F.upper("p_name").alias("title"))


@query("f08_enabled_jobs", "SELECT c_name AS name, c_mktsegment AS selector FROM customer WHERE c_acctbal > 0")
def enabled_jobs(spark: SparkSession, folder: str) -> DataFrame:
    specs = scan(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("selector"), (F.col("c_acctbal") > 0).alias("enabled")
    )
    return filters.enabled(specs).drop("enabled")


@query("f09_due_targets", f"SELECT id, interval_sec, last_check FROM ({TARGETS_SQL}) WHERE 2100 - last_check >= interval_sec")
def due_targets(spark: SparkSession, folder: str) -> DataFrame:
    return filters.due(targets(spark, folder), F.lit(2100)).select("id", "interval_sec", "last_check")


@query("f10_reserved_addresses", """
    WITH octets AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
               CASE l_linenumber WHEN 1 THEN 10 WHEN 2 THEN 172 WHEN 3 THEN 192 WHEN 4 THEN 100 WHEN 5 THEN 198 WHEN 6 THEN 169 ELSE l_partkey % 256 END AS a,
               CASE l_linenumber WHEN 3 THEN 168 - l_suppkey % 2 WHEN 6 THEN 254 ELSE l_suppkey % 256 END AS b
        FROM lineitem),
    judged AS (
        SELECT *, a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)
            OR (a = 198 AND b IN (18, 19)) OR (a = 169 AND b = 254) OR (a = 192 AND b = 0) AS forbidden FROM octets)
    SELECT form, forbidden, count(*) AS n FROM (
        SELECT 'v4' AS form, forbidden FROM judged
        UNION ALL SELECT 'mapped', forbidden FROM judged
        UNION ALL SELECT '6to4', forbidden FROM judged
        UNION ALL SELECT 'nat64', forbidden FROM judged
        UNION ALL SELECT 'ula', true FROM judged
        UNION ALL SELECT 'global', false FROM judged
        UNION ALL SELECT 'text', NULL FROM judged) GROUP BY form, forbidden
""")
def reserved_addresses(spark: SparkSession, folder: str) -> DataFrame:
    number, supplier, part = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    first = (
        F.when(number == 1, 10).when(number == 2, 172).when(number == 3, 192).when(number == 4, 100).when(number == 5, 198)
        .when(number == 6, 169).otherwise(F.pmod(part, F.lit(256)))
    )
    second = F.when(number == 3, 168 - F.pmod(supplier, F.lit(2))).when(number == 6, 254).otherwise(F.pmod(supplier, F.lit(256)))
    lines = scan(spark, folder, "lineitem").select(first.cast("bigint").alias("a"), second.cast("bigint").alias("b"))
    pair = F.lower(F.concat(F.lpad(F.hex("a"), 2, "0"), F.lpad(F.hex("b"), 2, "0")))
    v4 = F.concat_ws(".", F.col("a").cast("string"), F.col("b").cast("string"), F.lit("2"), F.lit("1"))
    forms = {
        "v4": v4, "mapped": F.concat(F.lit("::FFFF:"), v4), "6to4": F.concat(F.lit("2002:"), pair, F.lit(":201::1")),
        "nat64": F.concat(F.lit("64:ff9b::"), v4), "ula": F.concat(F.lit("fd00:"), pair, F.lit("::1")),
        "global": F.concat(F.lit("2a00:"), pair, F.lit(":1:2:3:4:5:6")), "text": F.concat(pair, F.lit(".example.com")),
    }
    listed = F.array(*[F.struct(F.lit(name).alias("form"), address.alias("address")) for name, address in forms.items()])
    judged = lines.select(F.inline(listed)).select("form", addresses.is_forbidden(F.col("address")).alias("forbidden"))
    return judged.groupBy("form", "forbidden").agg(F.count(F.lit(1)).alias("n"))


@query("f11_digest_threshold", """
    SELECT conv_id, turn FROM (
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n
        FROM conversations) WHERE n >= 4 AND place <= 5
""")
def digest_threshold(spark: SparkSession, folder: str) -> DataFrame:
    turns = scan(spark, folder, "conversations").select("conv_id", "turn")
    runs = digest.threshold(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("item_count")), 4)
    first = digest.first_items(turns, ["conv_id"], ["turn"], 5)
    return first.join(runs.select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn")


HASH = "sha256(concat('lang', chr(0), lang, chr(0), 'source', chr(0), source, chr(0), 'text', chr(0), \"text\", chr(0)))"


@query("d01_item_hash", f"""
    SELECT doc_id, {HASH} AS every_field,
           CASE WHEN lang = 'en' THEN {HASH} ELSE sha256(concat('blank', chr(0), chr(0), 'only', chr(0), lang, chr(0))) END AS chosen
    FROM documents
""")
def item_hash(spark: SparkSession, folder: str) -> DataFrame:
    items = document_items(spark, folder)
    # 'only' is filled for other languages than English; with both chosen fields blank all fields count.
    lang = filters.field("lang")
    only = filters.with_field(F.col("fields"), "only", F.when(lang == "en", "  ").otherwise(lang))
    chosen = F.when(lang == "en", content_hash(F.col("fields"), ["only", "blank"])).otherwise(content_hash(only, [" only", "blank", ""]))
    return items.select(F.col("page_id").alias("doc_id"), content_hash(F.col("fields")).alias("every_field"), chosen.alias("chosen"))


TEXT_HASH = "sha256(concat('text', chr(0), \"text\", chr(0)))"


@query("d02_incremental_dedup", f"""
    WITH h AS (SELECT doc_id, doc_id % 2 AS batch, {TEXT_HASH} AS hash FROM documents)
    SELECT min(doc_id) AS doc_id, hash FROM h WHERE batch = 1 AND hash NOT IN (SELECT hash FROM h WHERE batch = 0) GROUP BY hash
""")
def incremental_dedup(spark: SparkSession, folder: str) -> DataFrame:
    items = dedup.hashed(document_items(spark, folder), ["text"])
    odd = F.pmod(F.col("page_id"), F.lit(2)) == 1
    new = dedup.new_items(items.where(odd).select("page_id", "item_ord", "hash"), items.where(~odd), ["page_id", "item_ord"])
    return new.select(F.col("page_id").alias("doc_id"), "hash")


@query("d02_job_scope_dedup", f"""
    WITH h AS (SELECT doc_id, source, doc_id % 2 AS batch, {TEXT_HASH} AS hash FROM documents)
    SELECT min(doc_id) AS doc_id, source AS job_id FROM h a WHERE batch = 1
      AND NOT EXISTS (SELECT 1 FROM h b WHERE b.batch = 0 AND b.hash = a.hash AND b.source = a.source) GROUP BY source, hash
""")
def job_scope_dedup(spark: SparkSession, folder: str) -> DataFrame:
    items = dedup.hashed(document_items(spark, folder), ["text"])
    odd = F.pmod(F.col("page_id"), F.lit(2)) == 1
    new = dedup.new_items(items.where(odd), items.where(~odd), ["page_id", "item_ord"], scope="job")
    return new.select(F.col("page_id").alias("doc_id"), "job_id")


@query("d03_exact_url_dedup", """
    SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'monitor:' || l_partkey ELSE 'monitor:0' || l_partkey END AS url FROM lineitem
""")
def exact_url_dedup(spark: SparkSession, folder: str) -> DataFrame:
    prefix = F.when(F.pmod("l_linenumber", F.lit(2)) == 0, "monitor:").otherwise("monitor:0")
    return dedup.distinct_urls(scan(spark, folder, "lineitem").select(F.concat(prefix, F.col("l_partkey").cast("string")).alias("url")))


@query("w04_first_occurrence", f"""
    SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang
""")
def first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "documents").select("doc_id", "source", "lang")
    return dedup.first_of_each(rows, ["source", "lang"], ["doc_id"])


@query("j01_unseen_items", """
    SELECT doc_id FROM documents WHERE "text" NOT IN (SELECT "text" FROM benchmark) AND doc_id NOT IN (SELECT doc_id FROM labels)
""")
def unseen_items(spark: SparkSession, folder: str) -> DataFrame:
    items = dedup.hashed(document_items(spark, folder), ["text"])
    known = scan(spark, folder, "labels").select(F.col("doc_id").alias("page_id"))
    bench = dedup.hashed(scan(spark, folder, "benchmark").select(string_map(text=F.col("text")).alias("fields")), ["text"])
    left = dedup.unseen(dedup.unseen(items, bench), known, ["page_id"])
    return left.select(F.col("page_id").alias("doc_id"))


ENTRY_SQL = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'monitor:x' || o_custkey WHEN o_orderpriority = '2-HIGH' THEN 'https://x/' ELSE 'monitor:' || o_custkey END"


@query("j02_target_lookup", f"""
    SELECT o_orderkey, t.id, t.url FROM (SELECT o_orderkey, {ENTRY_SQL} AS entry FROM orders) JOIN ({TARGETS_SQL}) t ON entry = 'monitor:' || t.id
""")
def target_lookup(spark: SparkSession, folder: str) -> DataFrame:
    priority, key = F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    entry = F.when(priority == "1-URGENT", F.concat(F.lit("monitor:x"), key)).when(priority == "2-HIGH", "https://x/").otherwise(
        F.concat(F.lit("monitor:"), key)
    )
    batch = scan(spark, folder, "orders").select("o_orderkey", entry.alias("entry"))
    return frontier.monitor_targets(batch, targets(spark, folder).select("id", "url")).select("o_orderkey", "id", "url")


@query("j03_job_page_routing", """
    WITH jobs AS (SELECT host AS job, list(url) AS urls FROM (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, url FROM pages) GROUP BY host),
    wanted AS (SELECT job, unnest(urls) AS url FROM jobs)
    SELECT w.job, p.page_id FROM wanted w JOIN pages p ON p.url = w.url
""")
def job_page_routing(spark: SparkSession, folder: str) -> DataFrame:
    pages = scan(spark, folder, "pages").select("page_id", "url")
    listed = pages.select(F.regexp_extract("url", "://([^/]*)", 1).alias("job"), F.array("url").alias("urls"))
    return frontier.route(listed, pages, "job").select("job", "page_id")


@query("j04_blocklist_anti_join", """
    SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE lower(n_name) NOT IN (SELECT lower(n_name) FROM nation WHERE n_regionkey = 2)
""")
def blocklist_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    nations = scan(spark, folder, "nation")
    named = scan(spark, folder, "supplier").join(small(nations), F.col("n_nationkey") == F.col("s_nationkey"))
    blocked = nations.where(F.col("n_regionkey") == 2).select(F.col("n_name").alias("blocked_name"))
    return filters.not_blocked(named, blocked, F.col("n_name"), "blocked_name").select("s_suppkey", "s_name")


@query("j05_visited_anti_join", """
    SELECT DISTINCT l_partkey AS url FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
""")
def visited_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "lineitem").select(F.col("l_partkey").alias("url"), "l_returnflag")
    pushed = dedup.distinct_urls(rows.where("l_returnflag = 'R'").select("url"))
    return dedup.unseen(pushed, rows.where("l_returnflag = 'A'").select("url").distinct(), ["url"])


@query("s02_crawl_log", f"""
    SELECT attempt_id, error IS NULL AND status BETWEEN 200 AND 299 AS ok, error IS NULL AS answered, status, error,
           CASE WHEN error IS NOT NULL THEN error WHEN status NOT BETWEEN 200 AND 299 THEN 'http status: ' || status END AS failure,
           CASE WHEN error IS NULL AND status NOT BETWEEN 200 AND 299 THEN 'http' END AS answer_kind FROM ({ATTEMPTS_SQL})
""")
def crawl_log(spark: SparkSession, folder: str) -> DataFrame:
    log = attempts(event_attempts(spark, folder))
    return log.select("attempt_id", "ok", F.col("response").isNotNull().alias("answered"), F.col("response.status").alias("status"), "error",
                      F.col("failure.message").alias("failure"), F.when(F.col("response").isNotNull(), F.col("failure.kind")).alias("answer_kind"))


@query("c13_price_parse", f"""
    SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN NULL ELSE CAST(printf('%.2f', p_retailprice) AS DOUBLE) END AS price FROM part
""")
def price_parse(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "part").select("p_partkey", text.price(price_text()).alias("price"))
