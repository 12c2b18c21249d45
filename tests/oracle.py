"""Comparison of a Spark query with its SQL twin run by DuckDB over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def differences(columns: list[str], rows: list[tuple], sql_columns: list[str], sql_rows: list[tuple]) -> list[str]:
    """Empty when both have the same columns and the same rows in any order."""
    if sorted(columns) != sorted(sql_columns):
        return [f"columns {sorted(columns)} and {sorted(sql_columns)}"]
    order = sorted(columns)
    a = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(plain(r[sql_columns.index(c)]) for c in order) for r in sql_rows), key=repr)
    out = [] if len(a) == len(b) else [f"{len(a)} rows and {len(b)}"]
    from collections import Counter

    left, right = Counter(a), Counter(b)
    return out + [f"only Spark: {x}" for x in list((left - right))[:3]] + [f"only SQL: {x}" for x in list((right - left))[:3]]


def compare(spark, sf_dir: str, f, sql: str) -> list[str]:
    df = f(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cur = connect(sf_dir).execute(sql)
    return differences(df.columns, rows, [x[0] for x in cur.description], cur.fetchall())
