"""Every query with SQL, held against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from eventloom.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v).replace(" 00:00:00", "")


def _rows(df):
    return sorted((tuple(_plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DIR).toPandas(), duck.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DIR).count() >= 0
