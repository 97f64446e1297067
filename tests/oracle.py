"""Compares a query with its SQL as sorted rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, query, sql, d, tables=TABLES):
    df = query(spark, d)
    c = duckdb.connect()
    for t in tables:
        path = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    c.execute("SET TimeZone='UTC'")
    q = c.execute(sql)
    names = [x[0] for x in q.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, q.fetchall())
    assert len(got) == len(want)
    assert got == want
