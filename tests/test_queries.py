"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    rows = entry.queries()[name](spark, FOLDER)
    if name in SQLS:
        assert differences(rows, duck, SQLS[name]) is None
    else:
        assert rows.columns and rows.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
