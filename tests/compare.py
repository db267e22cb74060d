"""Side-by-side comparison of the Spark queries with their SQL text in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        value = float(value)
        return 0.0 if value == 0 else value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs first."""
    names, got = rows_of(df.columns, df.collect())
    con.execute(sql)
    cols = [c[0] for c in con.description]
    want_names, want = rows_of(cols, con.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            near = all(
                a == b
                or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9))
                for a, b in zip(g, w)
            )
            return f"{'nearly ' if near else ''}different: {names}\n {g}\n {w}"
    return None
