"""Every query that has SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from weftline.plans.queries import QUERIES, SQL

DATA = os.environ.get("WEFTLINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(map(repr, map(tuple, df.select(columns).collect())))
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    else:
        assert rows or name.startswith("strict")


def test_entry(spark):
    assert {"split", "reason", "n_rows"} == set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
