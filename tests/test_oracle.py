"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenshelf.plans import shop

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(table):
    return sorted((tuple(None if v != v else round(v, 5) if isinstance(v, float) else v for v in r) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(shop.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = shop.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({shop.ORACLE_SQL[name].strip()})")
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
