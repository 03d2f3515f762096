"""A query next to its reference SQL."""

import os

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def reference(sql, folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql)


def same(spark, name, folder):
    from curbline.llm.queries import QUERIES, SQL

    got = QUERIES[name](spark, folder)
    want = reference(SQL[name], folder)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    left = sorted((tuple(r) for r in got.select(*order).collect()), key=key)
    right = sorted(want.select(*order).fetchall(), key=key)
    assert left == right and left
