"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from terrace.plans import registry

SF = "/root/testdata/sf0.001"


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    want = pd.DataFrame(found.fetchall(), columns=[d[0] for d in found.description])
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want))
