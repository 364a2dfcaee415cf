"""Every registered query with SQL gives the rows that the SQL gives in DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

from tidewater.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        return str(v.date())
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name].replace("/root/testdata/sf0.01", sf))
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_batch_tiers_of_missing_values(spark, tmp_path):
    """Events without user, value or time get the tiers that the SQL gives them."""
    events = """(values (1, 10, 7, null), (2, 20, 7, 450.0), (3, 30, 7, null), (4, null, 7, 100.0), (5, 40, 7, 49.0), (6, 10, null, 400.0), (7, 20, null, 200.0),
        (8, 30, null, 1500.0), (null, 50, 7, 2000.0), (9, 50, 7, 1.0), (10, 10, 8, null)) v(event_id, sec, user_id, value)"""
    con = duckdb.connect()
    con.execute(f"copy (select event_id::bigint as event_id, make_timestamp(sec * 1000000) as ts, user_id::bigint as user_id, value::double as value from {events}) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got, want = QUERIES["batch_tiers"](spark, str(tmp_path)), con.execute(SQL["batch_tiers"])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_samples(spark, sf):
    """Samples hold rows of the table, each once, the same ones again, and about as many as asked for."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    n = orders.count()
    for name, low, high in (("sample_rows", 0.05, 0.2), ("sample_block", 0, 0.1)):
        got = QUERIES[name](spark, sf)
        again = sorted(r.o_orderkey for r in QUERIES[name](spark, sf).collect())
        assert sorted(r.o_orderkey for r in got.collect()) == again == sorted(set(again))
        assert got.exceptAll(orders).isEmpty() and low * n <= len(again) <= high * n


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"sample_rows", "sample_block"}
