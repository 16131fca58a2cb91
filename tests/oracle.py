"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def compare(spark, sf, run, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = run(spark, sf)
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    assert got == want
