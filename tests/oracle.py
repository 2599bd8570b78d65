"""Compares a query with its SQL on DuckDB, without regard to order."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating, decimal.Decimal, int, np.integer)):
        return None if x != x else round(float(x), 4)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, (pd.Timestamp, datetime.datetime, datetime.date)):
        return str(pd.Timestamp(x))
    return x


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def connection(folder: str):
    con = duckdb.connect()
    for f in Path(folder).iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con
