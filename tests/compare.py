"""Compares a query with its SQL, as sorted rows of values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in cur.fetchall()), key=str)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(r[n]) for n in names) for r in df.select(*(df[n] for n in names)).collect()), key=str)
