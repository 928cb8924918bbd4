"""Comparison of a query with its SQL, as multisets of rows."""

import math
from pathlib import Path

import duckdb


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, int) else str(v)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def compare(df, sql: str, sf_dir: str) -> int:
    names, expected = sql_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    a = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in expected), key=repr)
    assert a == b
    return len(a)
