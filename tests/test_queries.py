"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from assayer.plans import oracle, queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, datetime.datetime) else v


def table(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = queries.queries()[name](spark, str(DATA))
    want = duck.sql(oracle.oracle_sql()[name])
    assert table(df.collect(), df.columns) == table(want.fetchall(), want.columns)


def test_registry(spark):
    assert set(oracle.oracle_sql()) <= set(queries.queries()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0


def test_only_kmeans_has_no_sql():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == {"kmeans_slices"}


def test_kmeans_numbers_are_canonical(spark):
    rows = queries.kmeans_slices(spark, str(DATA)).collect()
    least = {}
    for r in rows:
        least[r.cluster_number] = min(least.get(r.cluster_number, r.vec_id), r.vec_id)
    assert [least[n] for n in sorted(least)] == sorted(least.values()) and len(least) == 10
