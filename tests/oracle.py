"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf: str) -> None:
    con = connect(sf)
    rel = con.sql(sql)
    want_names, want = rel.columns, rel.fetchall()
    assert sorted(df.columns) == sorted(want_names)
    got, want = rows_of(df.columns, df.collect()), rows_of(want_names, want)
    assert len(got) == len(want), (len(got), len(want))
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:3]
