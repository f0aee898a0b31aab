"""Compares a registered query with its SQL in DuckDB, row by row."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int) and not isinstance(value, bool):
        return float(f"{value:.9g}") if abs(value) < 1 << 40 else value
    return str(value) if value is not None and not isinstance(value, bool) else value


def difference(df, con, sql: str) -> str:
    """Empty where both have the same columns and the same rows."""
    names = sorted(df.columns)
    mine = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    found = con.execute(sql)
    theirs_names = [d[0] for d in found.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
