"""Compares a query's rows with those of its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, folder: str, replace: dict | None = None):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(sql)
    names = [c[0] for c in rel.description]
    return names, rel.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def same(df, sql: str, folder: str) -> None:
    names, expected = rows_of_sql(sql, folder)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(repr(plain(r[c])) for c in order) for r in df.collect()))
    want = sorted(tuple(repr(plain(dict(zip(names, r))[c])) for c in order) for r in expected)
    assert len(got) == len(want)
    assert got == want
