"""Comparison of a Spark result with a DuckDB result."""

import math
import os

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def normalized(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))
