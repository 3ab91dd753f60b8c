"""Spark result against DuckDB result: names, row count, values whatever the order."""

from __future__ import annotations

import duckdb
import pandas as pd

VIEWS = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for view in VIEWS:
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf_dir}/{view}.parquet'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in r) for r in ordered.itertuples(index=False))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(rows(got), rows(want)):
        if a != b:
            return f"{a} != {b}"
    return None
