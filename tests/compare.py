"""Runs a query and its SQL twin and says how the rows differ."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path = sorted(glob.glob(path + "/*.parquet"))
        elif not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({path!r})")
    return con


def plain(x):
    """A value that two engines can be compared by."""
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if hasattr(x, "asDict"):
        return plain(list(x.asDict().values()))
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(x[k])}" for k in sorted(x)) + "}"
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if columns and rows agree, else what differs first."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = connect(sf_dir).execute(sql)
    names = [d[0] for d in out.description]
    want = rows_of(names, out.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    left, right = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; only here {sorted(left)[:2]}; only in SQL {sorted(right)[:2]}"
