"""Compares queries with their SQL: the same columns, rows and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if hasattr(x, "isoformat"):
        return x.isoformat(" ")[:19] if hasattr(x, "hour") else x.isoformat()
    return str(x)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, text: str) -> list[str]:
    got = con.execute(text)
    theirs = [d[0] for d in got.description]
    if sorted(theirs) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(theirs)}"]
    ours, want = rows_of(df.columns, df.collect()), rows_of(theirs, got.fetchall())
    if len(ours) != len(want):
        return [f"{len(ours)} rows and {len(want)}"]
    return [f"{a} and {b}" for a, b in zip(ours, want, strict=True) if a != b][:3]
