"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(row[i]) for i in order]) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> str | None:
    cursor = con.execute(sql)
    wanted_columns = [d[0] for d in cursor.description]
    wanted_types = dict(zip(wanted_columns, (str(d[1]) for d in cursor.description)))
    wanted = rows_of(wanted_columns, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != wanted[0]:
        return f"columns {got[0]} but SQL has {wanted[0]}"
    kinds = {c: (KINDS.get(t, t), wanted_types[c]) for c, t in df.dtypes if KINDS.get(t, t) != wanted_types[c]}
    if len(got[1]) != len(wanted[1]):
        return f"{len(got[1])} rows but SQL has {len(wanted[1])}"
    if got[1] != wanted[1]:
        mine, theirs = set(got[1]) - set(wanted[1]), set(wanted[1]) - set(got[1])
        return f"values differ: {sorted(mine)[:2]} but SQL has {sorted(theirs)[:2]}"
    return f"types {kinds}" if kinds else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from pagewatch.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            problem = differences(df, con, sqls[name]) if name in sqls else f"(no SQL) {len(df.collect())} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem) and not problem.startswith("(no SQL)")
        print(f"{name:32} {time.time() - began:6.2f}s {problem or 'same'}", flush=True)
    print("problems:", bad)
