"""Every registered query of the store against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from keystrata.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_all_queries_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_get_reaches_the_scan(spark):
    p = plan(catalogue.queries()["kv_point_get"](spark, DIR))
    assert "EqualTo(o_orderkey,4242)" in p and "Python" not in p


def test_range_reaches_the_scan(spark):
    p = plan(catalogue.queries()["kv_range_scan"](spark, DIR))
    assert "GreaterThanOrEqual(o_orderkey,1000)" in p and "LessThanOrEqual(o_orderkey,2000)" in p


def test_no_cartesian_product(spark):
    for name, q in catalogue.queries().items():
        if name not in ("kv_statement_suite", "kv_stream_upsert"):
            assert "CartesianProduct" not in plan(q(spark, DIR)), name
