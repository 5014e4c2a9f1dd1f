"""Rows of Spark and of DuckDB side by side, whatever their order."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([_plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.5f}".rstrip("0").rstrip(".") if abs(v) < 1e15 else repr(float(v))
    return str(v)


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False))


def same(spark_df, duck_df) -> None:
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(duck_df.columns)
    a, b = rows(got), rows(duck_df)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, bad[:3]
