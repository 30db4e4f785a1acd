"""Comparison of a query with its DuckDB twin over the given tables."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def rounded(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(rounded(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    df = query(spark, data)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows_of(columns, found.fetchall())
