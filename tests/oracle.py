"""Runs a query's SQL in DuckDB on the same files and compares whole results."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat()
    if type(x).__name__ == "Decimal":
        return round(float(x), 9)
    return x


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in found]
    return sorted(out, key=repr)


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if the results are equal, else what differs."""
    con = duck(sf_dir)
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    want, got = rows(rel.columns, rel.fetchall()), rows(df.columns, df.collect())
    if want == got:
        return ""
    extra = [r for r in got if r not in set(want)][:3] if len(got) < 200_000 else []
    missing = [r for r in want if r not in set(got)][:3] if len(want) < 200_000 else []
    return f"{len(got)} rows, {len(want)} in SQL; only here {extra}; only in SQL {missing}"
