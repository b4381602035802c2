"""A query's rows against its SQL in DuckDB."""

from __future__ import annotations

import os

DATA = "/root/testdata"


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(sf_dir):
        path = f"{sf_dir}/{t}"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    return x


def same(df, con, sql: str) -> None:
    got, r = df.collect(), con.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    at = [r.columns.index(c) for c in df.columns]
    a = sorted((tuple(norm(v) for v in row) for row in got), key=repr)
    b = sorted((tuple(norm(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert a == b
