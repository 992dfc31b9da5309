"""Compares a query with its SQL on DuckDB."""

import math
import os

import duckdb


def rows(values):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
        return int(v) if isinstance(v, bool) else v

    return sorted(repr(tuple(one(v) for v in r)) for r in values)


def expected(sql, sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    r = c.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return [r.columns[i] for i in order], rows([[x[i] for i in order] for x in r.fetchall()])


def assert_same(df, sql, sf):
    names, want = expected(sql, sf)
    assert sorted(df.columns) == names
    assert rows(df.select(*[f"`{c}`" for c in names]).collect()) == want
