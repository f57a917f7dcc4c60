"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from taxoweave.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE:
        assert len(mine)
        return
    theirs = duck.execute(ORACLE[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
