"""Comparison of a Spark result with a DuckDB one, as rows without order."""

from __future__ import annotations

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, (float, np.floating)):
        return int(v) if v == int(v) else float(v)
    return int(v) if isinstance(v, np.integer) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(_plain, r))) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))
