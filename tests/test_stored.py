"""Stored tables: counts of affected rows, versions, and changes that fail."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewatch.sources.stored import StoredTable

SCHEMA = "id bigint, name string, value double"


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable(spark, str(tmp_path), SCHEMA, ["id"], buckets=4)


def told(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def test_every_change_counts_its_rows(spark, table):
    assert told(table.rows()) == []
    assert table.insert(rows(spark, (1, "alpha", 1.5))) == 1
    assert table.insert(rows(spark, (2, "beta", 2.5), (3, "gamma", 3.5), (None, "none", None))) == 3
    assert table.insert_or_ignore(rows(spark, (3, "again", 0.0), (4, "delta", 2.0), (4, "delta", 1.0), (None, "again", None)), ["value"]) == 1
    assert table.update(F.col("name") == "alpha", {"value": F.lit(99.9)}) == 1
    assert table.update(F.col("value") > 1000, {"value": F.lit(0.0)}) == 0
    assert table.delete(F.col("name") == "gamma") == 1
    assert table.upsert(spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2), (7, 7.0, 1)], "id bigint, value double, at int"), "at") == 3
    assert told(table.rows()) == sorted([(1, "alpha", 6.0), (2, "beta", 2.5), (4, "delta", 1.0), (7, None, 7.0), (None, "none", None)], key=str)
    assert told(table.rows(0)) == [(1, "alpha", 1.5)]
    assert [r["affected"] for r in table.history().orderBy("version").collect()] == [1, 3, 1, 1, 0, 1, 3]


def test_an_insert_of_a_known_or_repeated_key_changes_nothing(spark, table):
    table.insert(rows(spark, (1, "a", 1.0)))
    for bad in ([(1, "b", 2.0)], [(2, "b", 2.0), (2, "c", 3.0)]):
        with pytest.raises(ValueError, match="not unique"):
            table.insert(rows(spark, *bad))
    with pytest.raises(ValueError, match="no order"):
        table.upsert(rows(spark, (2, "b", 2.0), (2, "c", 3.0)))
    assert told(table.rows()) == [(1, "a", 1.0)] and table.history().count() == 1


def test_only_touched_buckets_are_written(spark, table, tmp_path):
    table.insert(spark.range(200).selectExpr("id", "'n' AS name", "0D AS value"))
    table.update(F.col("id") == 7, {"name": F.lit("seven")})
    assert len(list((tmp_path / "data" / "version=0").glob("bucket=*"))) == 4
    assert len(list((tmp_path / "data" / "version=1").glob("bucket=*"))) == 1
    assert table.rows().where("name = 'seven'").count() == 1 and table.rows().count() == 200


def test_what_a_failed_change_wrote_is_not_read(spark, table, tmp_path):
    table.insert(rows(spark, (1, "a", 1.0)))
    leftover = rows(spark, (9, "ghost", 0.0)).withColumn("bucket", F.lit(0))
    leftover.write.partitionBy("bucket").parquet(f"{tmp_path}/data/version=1")
    assert told(table.rows()) == [(1, "a", 1.0)]
    assert table.insert(rows(spark, (2, "b", 2.0))) == 1
    assert told(table.rows()) == [(1, "a", 1.0), (2, "b", 2.0)]


def test_an_emptied_table_is_empty(spark, table):
    table.insert(rows(spark, (1, "a", 1.0)))
    assert table.delete(F.lit(True)) == 1 and told(table.rows()) == []
    assert table.insert(rows(spark, (1, "b", 1.0))) == 1
