"""Runs a query's SQL in DuckDB over the same tables and compares rows whatever their order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(df, sql, sf_dir):
    names, rows = sql_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=repr)
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a == b
