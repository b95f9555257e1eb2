"""Local stand-in for the driver's comparison: Spark query vs DuckDB SQL.

Rows are compared as an order-insensitive multiset after rounding floats;
column names must match exactly.
"""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist(), digits)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, digits)) for k, x in v.items()))
    if isinstance(v, int):
        return v
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    out = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(out, key=repr)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return cols, sorted(out, key=repr)


def compare(spark, key: str, fn, sql: str, sf_dir: str, con=None):
    con = con or duck(sf_dir)
    s_cols, s_rows = rows_of_spark(fn(spark, sf_dir))
    d_cols, d_rows = rows_of_duck(con, sql)
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows)
