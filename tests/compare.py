"""Order-insensitive comparison of a Spark result with a DuckDB statement."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9) + 0.0 if abs(value) < 1e6 else float(f"{value:.13g}")
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    cleaned = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(cleaned, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark_df, con, sql):
    """None when equal, else a short description."""
    got = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want = normalised([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; first {got[1][:3]} / {want[1][:3]}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[:2]}" if wrong else None
