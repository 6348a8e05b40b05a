"""Every query with an SQL twin gives the same rows as DuckDB at sf0.001."""

import os

import duckdb
import pandas as pd
import pytest

from pressmill.plans import catalog

HEAVY = {"tfidf", "nb_model", "vocabulary"}


def _plain(x):
    if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
        return None
    if isinstance(x, bool):
        return x
    return round(float(x), 5) if isinstance(x, (int, float)) or type(x).__module__ == "numpy" or type(x).__name__ == "Decimal" else str(x)


def _rows(df):
    return sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE) - HEAVY))
def test_same_as_duckdb(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)
