"""Runs a query and its DuckDB twin over the same tables and compares names, row count and values in any order."""

import math
from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return int(x) if x.is_integer() else round(x, 9)
    return x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(x) for x in r]) for r in df[cols].itertuples(index=False))


def duck(sql, sf=SF):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con.execute(sql).df()


def check(spark, query, sql, sf=SF):
    got, want = rows(query(spark, sf).toPandas()), rows(duck(sql, sf))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
