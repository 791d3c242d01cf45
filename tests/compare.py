"""Compare a Spark result with DuckDB's result of the reference SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if type(x).__name__ == "Decimal":
        return int(x) if x == x.to_integral_value() else float(f"{float(x):.9g}")
    return str(x)


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql) -> str | None:
    """None when both agree, otherwise what differs."""
    mine = sorted_rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = sorted_rows(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        extra = [r for r in mine[:2000] if r not in set(theirs)][:2]
        lack = [r for r in theirs[:2000] if r not in set(mine)][:2]
        return f"rows {len(mine)} != {len(theirs)}; only here {extra}; only there {lack}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"values\n  here  {a}\n  there {b}"
    return None
