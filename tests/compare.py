"""Spark results against DuckDB on the same tables: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr), sorted(columns)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.sql(sql)
    want = rows(res.columns, res.fetchall())
    assert got[1] == want[1], (got[1], want[1])
    assert len(got[0]) == len(want[0]), (len(got[0]), len(want[0]))
    wrong = [(a, b) for a, b in zip(got[0], want[0]) if a != b]
    assert not wrong, wrong[:3]
