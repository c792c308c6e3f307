"""Run a query and its SQL on the same tables, and compare all rows."""

import glob
import os

import duckdb

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf}/{t}.parquet"):
            files = glob.glob(f"{p}/*.parquet") if os.path.isdir(p) else [p]
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def compare(spark, sf, query, sql):
    df = query(spark, sf)
    want = duck(sql, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
