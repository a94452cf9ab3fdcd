"""Queries of the training-corpus operators against their SQL."""

import os

import pytest

from vulnlake.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    names = sorted(frame.columns)
    cursor = connection.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})")
    assert sorted(map(str, (tuple(r[c] for c in names) for r in frame.collect()))) == sorted(map(str, cursor.fetchall()))
