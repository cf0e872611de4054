"""Compare a query with its SQL in DuckDB: row count, column names, types by class, and values."""
from __future__ import annotations

import glob
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df, sql: str, sf_dir: str) -> tuple[int, list]:
    """Number of rows, and the first differences."""
    con = views(sf_dir)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = rows_of(names, out.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return len(got), [("columns", sorted(df.columns), sorted(names))]
    if len(got) != len(want):
        return len(got), [("rows", len(got), len(want))]
    return len(got), [(a, b) for a, b in zip(got, want) if a != b][:3]
