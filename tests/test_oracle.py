"""Every registered sensor-event query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidelark.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def cell(v):
    if v is None or (not isinstance(v, list | np.ndarray) and pd.isna(v)):
        return "~"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | np.integer):
        return str(int(v))
    if isinstance(v, float | np.floating):
        return str(int(v)) if float(v).is_integer() else f"{v:.5g}"
    return str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
