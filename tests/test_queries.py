"""Every query with SQL beside it against DuckDB, at the smallest size."""

import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidelog.queries import ORACLES, QUERIES

from .conftest import DATA, needs_data

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or (not isinstance(x, str) and pd.isna(x)):
        return "~"
    if isinstance(x, (int, float, decimal.Decimal, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)):
        return round(float(x), 6)
    return str(x).removesuffix(" 00:00:00")


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
