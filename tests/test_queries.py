"""Registered queries against their SQL on the smallest test tables."""

import math
import os

import pytest

import __spark_entry__ as entry_points
from vulnlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in names] for r in frame.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    labels = [d[0] for d in cursor.description]
    assert sorted(labels) == names
    places = [labels.index(c) for c in names]
    want = sorted(([plain(r[i]) for i in places] for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["source", "total", "critical_count", "high_count", "medium_count"] and frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries()) and set(QUERIES) <= set(entry_points.queries())
