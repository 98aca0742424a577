"""Comparison of a query with its SQL twin in DuckDB."""

import math
import os

import duckdb


def connect(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


def _text(v):
    return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)


def same(spark, con, data, query, sql):
    df = query(spark, data)
    found = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    mine = [[df.columns.index(c) for c in names], df.collect()]
    other = [[found.columns.index(c) for c in names], found.fetchall()]
    a, b = (sorted(tuple(_text(r[i]) for i in order) for r in result) for order, result in (mine, other))
    assert a == b
