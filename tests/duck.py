"""Run a query and its SQL on the same tables, and compare all rows."""

import glob
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf}/{t}.parquet"):
            files = glob.glob(f"{p}/*.parquet") if os.path.isdir(p) else [p]
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    found = con.execute(sql)
    want = _rows([d[0] for d in found.description], found.fetchall())
    df = query(spark, sf)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
