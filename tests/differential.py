"""Compares queries with their SQL on one folder of tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty text if the rows agree, else what differs."""
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    return "" if got == want else f"{len(got)} and {len(want)} rows; {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
