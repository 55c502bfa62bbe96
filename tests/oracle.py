"""Runs a query in Spark and its oracle in DuckDB over the same tables and compares all rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def same(spark, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    ours = sorted(repr([_plain(r[c]) for c in names]) for r in frame.collect())
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    theirs = sorted(repr([_plain(r[columns.index(c)]) for c in names]) for r in cur.fetchall())
    assert sorted(columns) == names
    assert ours == theirs
