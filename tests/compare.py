"""Compares a query with its SQL over the same tables: columns, number of rows, values without order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    """One form for a value of either engine."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return (value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value).isoformat().replace("T00:00:00", "")
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree."""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    want, have = bag(columns, cursor.fetchall()), bag(df.columns, df.collect())
    if want == have:
        return ""
    return f"{have.total()} rows, SQL has {want.total()}; only here {list((have - want).items())[:3]}, only in SQL {list((want - have).items())[:3]}"
