"""Business queries against their oracles in DuckDB, on the smallest driver tables."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__ as entry
from shelfspark.plans import QUERIES, oracles

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("the driver tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime):
        return v.date().isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, str):
        return v
    return round(float(v), 6)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


ORACLES = oracles()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    want = table([c[0] for c in found.description], found.fetchall())
    assert table(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES))
def test_query_without_oracle_runs(spark, duck, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0
