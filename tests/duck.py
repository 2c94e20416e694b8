"""DuckDB on the same tables, and order-free comparison of results."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{path}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    names = sorted(cols)
    at = [cols.index(c) for c in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v
