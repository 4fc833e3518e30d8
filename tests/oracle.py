"""Compares a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(round(v, 6)) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, sf, query, sql):
    got, want = normal(query(spark, sf).toPandas()), normal(connection(sf).execute(sql).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
