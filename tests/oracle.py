"""Compares a Spark result with DuckDB's over the same Parquet tables, order aside."""

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if Path(path).exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if v is not None and not isinstance(v, str | bool | int | bytes):
        return float(v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql):
    """An empty text when both agree, else what differs."""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = normal(columns, cursor.fetchall())
    got = normal(df.columns, df.collect())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    apart = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(apart)} rows differ: {apart[:2]}" if apart else ""
