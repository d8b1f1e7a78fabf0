"""Results of Spark and DuckDB as comparable rows."""

import math
import os

import duckdb
import pandas as pd


def value(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(value, x))
    if x is None or (not isinstance(x, str | bytes) and pd.isna(x)):
        return None
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con
