"""Value comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]")
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows, in any order and with exactly the same values."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    got, want = _ordered(got), _ordered(want)
    wrong = []
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind and len(got):
            wrong.append(f"{c}: type {got[c].dtype} != {want[c].dtype}")
            continue
        unequal = (got[c] != want[c]) & ~(got[c].isna() & want[c].isna())
        if unequal.any():
            at = unequal.idxmax()
            wrong.append(f"{c}: {int(unequal.sum())} differ, first {got[c][at]!r} != {want[c][at]!r}")
    return "; ".join(wrong)
