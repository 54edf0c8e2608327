"""Rows of a Spark query against those of DuckDB over the same tables."""

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(sf + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


def same(df, sql, sf):
    cols = sorted(df.columns)
    a = sorted(repr(tuple(norm(r[k]) for k in cols)) for r in df.collect())
    r = duck(sf).sql(sql)
    assert sorted(r.columns) == cols
    ix = [r.columns.index(k) for k in cols]
    b = sorted(repr(tuple(norm(x[i]) for i in ix)) for x in r.fetchall())
    assert a == b
