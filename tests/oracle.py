"""Comparison of a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.datetime | datetime.date) else v


def views(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def same(df, sql, sf_dir):
    result = views(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
