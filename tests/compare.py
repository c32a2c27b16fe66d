"""Rows of a query against rows of its SQL: names, counts and values, in any order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def differences(df, con, sql: str) -> str:
    """Empty if the rows agree."""
    got = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(got.columns):
        return f"columns {names} and {sorted(got.columns)}"
    theirs = [dict(zip(got.columns, r, strict=True)) for r in got.fetchall()]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    a = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    b = sorted((tuple(plain(r[n]) for n in names) for r in theirs), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if any(u != v and not (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-9 * max(1, abs(u))) for u, v in zip(x, y, strict=True)):
            return f"{names}: {x} and {y}"
    return ""
