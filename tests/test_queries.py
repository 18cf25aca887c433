"""Every registered query of the engine's own operators against its SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue, rules

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return round(float(v), 6)
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    if name in catalogue.SQL:
        assert got == rows(duck.execute(catalogue.SQL[name]).fetchdf())
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert {rules.safe_url.__name__, rules.kind_backfill.__name__} <= set(e.queries())
    assert e.entry(spark).count() == 10
