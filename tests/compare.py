"""Order-insensitive comparison of a Spark result with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"n{v:.9g}"
    if isinstance(v, int):
        return f"n{float(v):.9g}" if abs(v) < 2**53 else f"n{v}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return type(v).__name__[0] + str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    cur = con.execute(sql)
    want_cols, want = normal([c[0] for c in cur.description], cur.fetchall())
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    if want != got:
        only_w = sorted(set(want) - set(got))[:3]
        only_g = sorted(set(got) - set(want))[:3]
        return f"rows {len(got)} != {len(want)}; spark only {only_g}; sql only {only_w}"
    return None if want else "EMPTY"
