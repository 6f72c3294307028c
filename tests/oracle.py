"""Compares a query's rows with those of its SQL on DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = c.sql(sql)
    columns = sorted(r.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in r.project(", ".join(f'"{x}"' for x in columns)).fetchall()), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    assert got == want
