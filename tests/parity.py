"""Comparison of a query with its SQL on the same tables, order aside."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, str, bytes)):
        return v
    if hasattr(v, "year"):
        return str(v)
    return float(v) if hasattr(v, "__float__") else str(list(v))


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(_plain(v) for v in r)) for r in frame.itertuples(index=False))


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    mine = query(spark, sf_dir).toPandas()
    other = connect(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
