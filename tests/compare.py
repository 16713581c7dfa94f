"""Runs registered queries against their checking SQL in an embedded engine."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "as_tuple"):
        return round(float(value), 9)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark, con, query, sql, sf_dir):
    """None when both sides agree, else a short report."""
    df = query(spark, sf_dir)
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}; spark {s_rows[:2]} sql {d_rows[:2]}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(s_rows)} differ, first: {str(bad[0][0])[:700]} != {str(bad[0][1])[:700]}"
    return None
