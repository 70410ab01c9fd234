"""Rows of a DataFrame and of DuckDB SQL, comparable."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def canonical(rows):
    return sorted((tuple(round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in rows), key=repr)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, canonical(tuple(r) for r in df.select(*columns).collect())


def duckdb_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), canonical(tuple(r[k] for k in order) for r in found.fetchall())
