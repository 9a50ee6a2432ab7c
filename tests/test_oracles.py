"""Every query with SQL gives the same rows in another engine, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import commerce, oracles

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def test_all_have_sql():
    assert set(commerce.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(commerce.QUERIES))
def test_same_rows(spark, db, name):
    got, want = commerce.QUERIES[name](spark, DIR).toPandas(), db.execute(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
