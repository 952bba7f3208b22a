import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from larmor import registry
from larmor.plans.queries import EXTRA


def settled(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float) if df[c].dtype.kind in "iuf" or str(df[c].dtype).startswith("Int") else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    sql = registry.oracle_sql()
    got = settled(registry.queries()[name](spark, sf_dir).toPandas())
    want = settled(duck.sql(sql[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9, rtol=1e-9)


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert registry.queries().keys() - registry.oracle_sql().keys() == EXTRA.keys()
    assert entry.entry(spark).count() == 10
    assert registry.queries().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(EXTRA))
def test_block_queries_run(spark, sf_dir, name):
    assert EXTRA[name](spark, sf_dir).count() > 0
