"""Runs a registered query and its SQL side by side and compares all values."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    return value


def _ordered(columns, rows):
    index = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in index]
    values = [tuple(_plain(row[i]) for i in index) for row in rows]
    return names, sorted(values, key=lambda v: tuple((x is None, str(type(x)), str(x)) for x in v))


def compare(df, sql: str, con) -> list[str]:
    """Differences between a DataFrame and a SQL text; an empty list means equal."""
    left_names, left = _ordered(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right_names, right = _ordered([d[0] for d in result.description], result.fetchall())
    if left_names != right_names:
        return [f"columns {left_names} != {right_names}"]
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}"]
    return [f"{a} != {b}" for a, b in zip(left, right, strict=True) if a != b]
