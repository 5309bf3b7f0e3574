"""Queries for the SQL surface, table maintenance, set operations and specification checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.operators import quality, tables
from pagewatch.plans.registry import query
from pagewatch.plans.samples import TARGETS_SQL, targets
from pagewatch.session import scratch
from pagewatch.sources.pages import scan
from pagewatch.sources.stored import StoredTable

STAR = ("customer", "orders", "lineitem")


def star(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: scan(spark, folder, name) for name in names}


REVENUE = """
    SELECT c.c_mktsegment, count(*) AS lines, CAST(round(sum(l.l_quantity)) AS BIGINT) AS quantity
    FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    WHERE l.l_discount < {low} AND ({nothing} IS NULL OR c.c_nationkey = 0) AND o.o_orderpriority = {priority} GROUP BY c.c_mktsegment
"""


@query("q01_parameterised_sql", REVENUE.format(low="0.05", nothing="NULL", priority="'1-URGENT'"))
def parameterised_sql(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(
        spark, REVENUE.format(low="?", nothing="?", priority="?"), [0.05, None, "1-URGENT"], **star(spark, folder, *STAR)
    )


@query("q02_insert_or_ignore", f"""
    SELECT id, interval_sec FROM ({TARGETS_SQL}) UNION ALL SELECT 's' || s_suppkey, CAST(60 AS BIGINT) FROM supplier
""")
def insert_or_ignore(spark: SparkSession, folder: str) -> DataFrame:
    base = targets(spark, folder).select("id", "interval_sec")
    suppliers = scan(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(60).cast("bigint").alias("interval_sec")
    )
    again = base.select("id", F.lit(1).cast("bigint").alias("interval_sec"))
    return tables.insert_or_ignore(base, tables.insert(suppliers, again), ["id"], ["interval_sec"])


@query("q03_upsert", f"""
    WITH changes AS (SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderkey) AS last_check FROM orders GROUP BY o_custkey)
    SELECT t.id, coalesce(c.last_check, t.last_check) AS last_check FROM ({TARGETS_SQL}) t LEFT JOIN changes c ON c.id = t.id
    UNION ALL SELECT id, last_check FROM changes WHERE id NOT IN (SELECT id FROM ({TARGETS_SQL}))
""")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    changes = scan(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("last_check"), F.col("o_orderkey").alias("seq")
    )
    return tables.upsert(targets(spark, folder).select("id", "last_check"), changes, ["id"], order="seq")


@query("q04_update_and_delete", f"""
    SELECT id, CASE WHEN segment = 'BUILDING' THEN interval_sec * 2 ELSE interval_sec END AS interval_sec, 'kept' AS part FROM ({TARGETS_SQL}) WHERE last_check >= 500
    UNION ALL SELECT id, interval_sec * 2, 'updated' FROM ({TARGETS_SQL}) WHERE segment = 'BUILDING'
    UNION ALL SELECT id, CASE WHEN segment = 'BUILDING' THEN interval_sec * 2 ELSE interval_sec END, 'deleted' FROM ({TARGETS_SQL}) WHERE last_check < 500
""")
def update_and_delete(spark: SparkSession, folder: str) -> DataFrame:
    after, changed = tables.update_where(
        targets(spark, folder), F.col("segment") == "BUILDING", {"interval_sec": F.col("interval_sec") * 2}
    )
    left, gone = tables.delete_where(after, F.col("last_check") < 500)
    parts = [(left, "kept"), (changed, "updated"), (gone, "deleted")]
    rows = [part.select("id", "interval_sec", F.lit(name).alias("part")) for part, name in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# The same five changes of one stored table, as tables of rows after each.
CHANGES_SQL = f"""
    base AS (SELECT id, interval_sec, segment FROM ({TARGETS_SQL})),
    added AS (SELECT * FROM base UNION ALL SELECT 's' || s_suppkey, 60, NULL FROM supplier),
    latest AS (SELECT CAST(o_custkey AS VARCHAR) AS id, max(o_orderkey) AS last FROM orders GROUP BY o_custkey),
    upserted AS (SELECT coalesce(a.id, l.id) AS id, coalesce(l.last, a.interval_sec) AS interval_sec, a.segment FROM added a FULL JOIN latest l ON l.id = a.id),
    updated AS (SELECT id, CASE WHEN segment = 'BUILDING' THEN interval_sec * 2 ELSE interval_sec END AS interval_sec, segment FROM upserted),
    remaining AS (SELECT * FROM updated WHERE interval_sec % 3 <> 0)
"""


def changed_targets(spark: SparkSession, folder: str) -> StoredTable:
    """Targets in a stored table, after an insert, an insert or ignore, an upsert, an update and a delete."""
    table = StoredTable(spark, scratch(spark), "id string, interval_sec bigint, segment string", ["id"])
    base = targets(spark, folder).select("id", "interval_sec", "segment")
    table.insert(base)
    suppliers = scan(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(60).cast("bigint").alias("interval_sec"))
    table.insert_or_ignore(tables.insert(suppliers, base.select("id", F.lit(1).cast("bigint").alias("interval_sec"))), ["interval_sec"])
    key = F.col("o_orderkey")
    table.upsert(scan(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("id"), key.alias("interval_sec"), key.alias("at")), "at")
    table.update(F.col("segment") == "BUILDING", {"interval_sec": F.col("interval_sec") * 2})
    table.delete(F.col("interval_sec") % 3 == 0)
    return table


@query("q02_stored_changes", f"""
    WITH {CHANGES_SQL}
    SELECT 0 AS version, 'insert' AS action, (SELECT count(*) FROM base) AS affected
    UNION ALL SELECT 1, 'insert or ignore', (SELECT count(*) FROM supplier)
    UNION ALL SELECT 2, 'upsert', (SELECT count(*) FROM orders)
    UNION ALL SELECT 3, 'update', (SELECT count(*) FROM upserted WHERE segment = 'BUILDING')
    UNION ALL SELECT 4, 'delete', (SELECT count(*) FROM updated WHERE interval_sec % 3 = 0)
""")
def stored_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changed_targets(spark, folder).history().select("version", "action", "affected")


@query("q04_stored_rows", f"WITH {CHANGES_SQL} SELECT 'last' AS which, * FROM remaining UNION ALL SELECT 'before', * FROM updated")
def stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table after all changes, and as it was before the last."""
    table = changed_targets(spark, folder)
    last, before = [rows.select(F.lit(name).alias("which"), "*") for name, rows in (("last", table.rows()), ("before", table.rows(3)))]
    return last.unionByName(before)


@query("q05_task_status_rollup", """
    SELECT CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_totalprice < 250000 THEN 'completed' ELSE 'failed' END WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
           o_orderpriority AS queue, count(*) AS tasks FROM orders GROUP BY ALL
""")
def task_status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders")
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), F.lit("pending").alias("status"), F.col("o_orderpriority").alias("queue"))
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") < 250000)
    results = orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("task_id"), done.alias("ok"))
    return tables.task_rollup(tables.advance_tasks(tasks, results), ["queue"])


JOINS = """
    SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, s.suppliers
    FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) s ON s_nationkey = n_nationkey
    WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name <> 'AFRICA')
      AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 0)
"""


@query("j06_sql_joins", JOINS)
def sql_joins(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(spark, JOINS, **star(spark, folder, "nation", "customer", "supplier", "region"))


AGGREGATION = """
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, CAST(sum(l_quantity) AS BIGINT) AS quantity
    FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
"""


@query("a09_sql_aggregation", AGGREGATION)
def sql_aggregation(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(spark, AGGREGATION, **star(spark, folder, "lineitem"))


WINDOWS = """
    SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
           lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders
"""


@query("w07_sql_window", "SELECT o_orderkey, CAST(place AS INTEGER) AS place, before FROM (" + WINDOWS + ")")
def sql_window(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(spark, WINDOWS, **star(spark, folder, "orders"))


SETS = """
    (SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier)
    INTERSECT SELECT n_nationkey FROM nation EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1
"""


@query("u03_sql_set_operations", SETS)
def sql_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(spark, SETS, **star(spark, folder, "customer", "supplier", "nation"))


def derived_specs(spark: SparkSession, folder: str) -> DataFrame:
    """A specification per customer, with faults planted by nation and market segment."""
    nation, segment, key = F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_custkey")

    def field(name, selector):
        return F.struct(F.lit(name).alias("name"), selector.alias("selector"), F.lit("text").alias("attr"))

    plain = F.array(field("title", F.lit("h1")), field("price", F.when(nation == 1, " ").otherwise(".price")))
    fields = (
        F.when(nation == 2, F.array_append(plain, field(" title ", F.lit("h2"))))
        .when(nation == 3, F.slice(plain, 1, 0)).when(nation == 4, F.array_append(plain, field(" ", F.lit("p")))).otherwise(plain)
    )
    names = F.when(nation == 5, "  ").otherwise(F.col("c_name"))
    no_list = F.lit(None).cast("array<string>")
    return scan(spark, folder, "customer").select(
        key.alias("c_custkey"), names.alias("name"),
        F.when(nation == 6, "www.example.com/x").when(nation == 7, "").otherwise("https://e.example.com/").alias("url"),
        F.when(nation == 8, "").otherwise("article").alias("selector"), fields.alias("fields"),
        F.when(segment == "BUILDING", F.array(F.lit(" price "), F.lit("ghost"))).otherwise(no_list).alias("search_fields"),
        F.when(segment == "MACHINERY", F.array(F.lit("spook"), F.lit(" "))).otherwise(no_list).alias("hash_fields"),
        F.when(nation == 9, F.array().cast("array<string>")).when(nation == 10, F.array(F.lit("https://a/"), F.lit("b"))).alias("urls"),
        F.when(nation == 11, 0).otherwise(600).cast("bigint").alias("interval"), F.when(nation == 12, 0).cast("bigint").alias("workers"),
        F.when(nation > 12, F.struct((nation > 13).alias("enabled"), F.when(nation == 14, "hook").otherwise("https://h/").alias("url"))).alias("webhook"),
        F.when(nation > 14, F.struct((nation < 17).alias("enabled"), F.lit("Sticky").alias("rotate"),
                                     F.when(nation == 15, F.array().cast("array<string>")).otherwise(F.array(F.lit("p:1"))).alias("urls"))).alias("proxy"),
    )


FAULTS = [
    ("c_nationkey = 5", "name is blank", "''"), ("c_nationkey = 6", "url is not absolute", "'www.example.com/x'"), ("c_nationkey = 7", "url is blank", "''"),
    ("c_nationkey = 8", "selector is blank", "''"), ("c_nationkey = 3", "no fields", "''"), ("c_nationkey = 11", "interval is not positive", "''"),
    ("c_nationkey = 12", "workers is not positive", "''"), ("c_nationkey = 9", "urls is empty", "''"), ("c_nationkey = 10", "urls holds a bad url", "'b'"),
    ("c_nationkey = 14", "webhook url is bad", "'hook'"), ("c_nationkey = 15", "proxy has no urls", "''"), ("c_nationkey = 16", "proxy holds a bad url", "'p:1'"),
    ("c_nationkey = 4", "field name is blank", "''"), ("c_nationkey = 1", "field selector is blank", "'price'"), ("c_nationkey = 2", "field name is repeated", "'title'"),
    ("c_mktsegment = 'BUILDING' AND c_nationkey <> 3", "search field is unknown", "'ghost'"), ("c_mktsegment = 'MACHINERY'", "hash field is unknown", "'spook'"),
    ("c_mktsegment = 'BUILDING' AND c_nationkey = 3", "search field is unknown", "'price, ghost'"),
]


@query("v01_spec_violations", " UNION ALL ".join(
    f"SELECT problem, detail, count(*) AS jobs FROM (SELECT '{problem}' AS problem, {detail} AS detail FROM customer WHERE {where}) GROUP BY ALL"
    for where, problem, detail in FAULTS
))
def spec_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.spec_violations(derived_specs(spark, folder))
    return found.groupBy("problem", "detail").agg(F.count(F.lit(1)).alias("jobs"))


@query("v02_set_violations", """
    WITH named AS (SELECT CASE WHEN l_linenumber < 4 THEN l_returnflag || '-' || l_partkey ELSE l_returnflag || ' ' || l_partkey || '!' END AS name FROM lineitem),
    both_kinds AS (SELECT 'name is repeated' AS problem, name AS value FROM named
                   UNION ALL SELECT 'id is repeated', trim(lower(regexp_replace(name, '[^A-Za-z0-9]', '_', 'g')), '_') FROM named)
    SELECT problem, value, count(*) AS jobs FROM both_kinds GROUP BY problem, value HAVING count(*) > 1
""")
def set_violations(spark: SparkSession, folder: str) -> DataFrame:
    flag, part = F.col("l_returnflag"), F.col("l_partkey").cast("string")
    name = F.when(F.col("l_linenumber") < 4, F.concat(flag, F.lit("-"), part)).otherwise(F.concat(flag, F.lit(" "), part, F.lit("!")))
    return quality.set_violations(scan(spark, folder, "lineitem").select(name.alias("name")))
