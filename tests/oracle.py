"""Runs a query and its SQL twin and compares schema names, row counts and sorted values."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (1, float(v))
    return (2, str(v))


def mismatch(df, con, sql: str, tol: float = 2e-6) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    cols, theirs_cols = sorted(df.columns), sorted(names)
    if cols != theirs_cols:
        return f"columns {cols} != {theirs_cols}"
    ours = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(_norm(r[i]) for i in at) for r in rows)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    exact = 0
    for a, b in zip(ours, theirs):
        if a != b:
            exact += 1
            for x, z in zip(a, b):
                if x[0] != z[0] or (x[0] == 1 and abs(x[1] - z[1]) > tol * max(1, abs(x[1]))) or (x[0] != 1 and x != z):
                    return f"{a} != {b}"
    if exact:
        print(f"  {exact} of {len(ours)} rows differ within tolerance")
    return None
