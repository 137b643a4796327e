"""Every registered query against its SQL oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    base = duckdb.connect()
    base.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    got = frame.collect()
    if name not in ORACLES:
        assert got
        return
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, got) == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(ORACLES) <= set(QUERIES)
