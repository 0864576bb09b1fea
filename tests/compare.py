"""Row comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty if both results hold the same rows and columns."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    extra, lacking = got - want, want - got
    return (
        f"{sum(got.values())} rows against {sum(want.values())}; "
        f"only Spark {sum(extra.values())}: {list(extra)[:2]}; "
        f"only SQL {sum(lacking.values())}: {list(lacking)[:2]}"
    )
