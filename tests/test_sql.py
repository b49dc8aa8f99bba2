"""Every query with SQL gives the same rows in another engine on the small tables; every other query runs."""

import glob
import math
import os

import pytest


def rows(columns, found):
    def plain(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 8) if isinstance(v, float) else v

    return sorted((repr(tuple(plain(r[c]) for c in columns)) for r in found))


@pytest.fixture(scope="module")
def other(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def test_core_queries(spark, data, other):
    from dialectica.plans import core, core_sql, problems, problems_sql

    queries, sql = core.QUERIES | problems.QUERIES, core_sql.ORACLE | problems_sql.ORACLE
    assert set(sql) <= set(queries)
    for name, q in queries.items():
        df = q(spark, data)
        got = df.collect()
        if name in sql:
            found = other.sql(sql[name])
            assert sorted(found.columns) == sorted(df.columns), name
            want = [dict(zip(found.columns, r)) for r in found.fetchall()]
            assert rows(sorted(df.columns), got) == rows(sorted(df.columns), want), name


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
