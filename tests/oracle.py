"""Comparing a query with its DuckDB oracle."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    return sorted(str(tuple(map(plain, r))) for r in rows)


def assert_equal(df, connection, sql):
    names = sorted(df.columns)
    got = rows_of(names, df.select(*[f"`{n}`" for n in names]).collect())
    want = connection.sql(sql)
    assert sorted(want.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    assert got == rows_of(names, connection.sql(f"select {quoted} from ({sql})").fetchall())
