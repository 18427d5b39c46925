"""Rows of a DuckDB query and of a DataFrame in a form that can be compared."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in x.items())
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return int(x) if x.is_integer() else round(x, 6)
    return x


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(_plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


def duck(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return con.execute(sql).df()


def assert_same(spark, name: str, query, sql: str, folder: str) -> None:
    got, want = query(spark, folder).toPandas(), duck(folder, sql)
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows_of(got) == rows_of(want), name
