"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "~nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str, show: int = 5) -> str:
    """Empty when equal, otherwise a short report."""
    found = con.execute(sql)
    duck_cols = [c[0] for c in found.description]
    if sorted(duck_cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(duck_cols)}"
    want = _rows(duck_cols, found.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got == want:
        return ""
    only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return (
        f"{len(got)} rows, expected {len(want)}; columns {sorted(spark_df.columns)}\n"
        f"  only here ({len(only_got)}): {only_got[:show]}\n  only in SQL ({len(only_want)}): {only_want[:show]}"
    )
