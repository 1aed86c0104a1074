"""Runs a query and its SQL side by side."""

import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return con


def plain(rows, columns):
    return sorted(repr(tuple(None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in columns)) for r in rows)


def same(spark, sf, query, sql) -> None:
    got = query(spark, sf)
    columns = sorted(got.columns)
    relation = connect(sf).sql(sql)
    assert sorted(relation.columns) == columns
    rows = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    assert plain(got.collect(), columns) == plain(rows, columns)
