"""Rows of a query against those of its SQL, as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np

SF = "/root/testdata/sf0.01"


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_plain, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (int, np.integer)):
        return int(v)
    return v


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(spark, query, sql: str, sf_dir: str = SF) -> None:
    found = query(spark, sf_dir)
    con = connection(sf_dir)
    wanted = con.execute(sql)
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    a, b = rows_of(found.columns, found.collect()), rows_of(columns, wanted.fetchall())
    assert a == b, f"{sum(a.values())} rows, {sum(b.values())} by SQL; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
