"""Rows of a Spark query and of its DuckDB text as comparable lists."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pandas as pd

from ledgerloom.plans.tables import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v) -> str:
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    if isinstance(v, datetime.date):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, sf_dir: str, fn, sql: str) -> None:
    df = fn(spark, sf_dir)
    got = df.collect()
    want = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
