"""Every registered query against its SQL, on the smallest given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, tables, name):
    got = entry_module.queries()[name](spark, FOLDER).toPandas()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    want = tables.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check._rows(got) == check._rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
