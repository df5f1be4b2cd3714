"""Runs a query's SQL twin in DuckDB and compares the rows as multisets."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def rows_of(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=lambda r: tuple(map(str, r)))


def oracle_rows(con, sql, columns):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=lambda r: tuple(map(str, r)))
