"""Holds a Spark result against its DuckDB twin."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() else v)
    return v


def rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def differences(df, sql: str, con) -> list[str]:
    """What differs, empty if nothing does."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    at = [names.index(n) for n in sorted(names)]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    ours = rows(df)
    if len(ours) != len(theirs):
        a, b = set(map(repr, ours)), set(map(repr, theirs))
        return [f"{len(ours)} and {len(theirs)} rows", *sorted(a - b)[:2], "against", *sorted(b - a)[:2]]
    bad = [f"{a} against {b}" for a, b in zip(ours, theirs) if a != b]
    return [f"{len(bad)} of {len(ours)} rows", *bad[:3]] if bad else []
