"""Holds a query's rows against its SQL on DuckDB, whatever the order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(map(_plain, row)) for row in df.select(*[f"`{c}`" for c in names]).collect())
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())
    assert ours == theirs
