"""Compares queries with their SQL on DuckDB."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, sf, name, query, sql):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert got[1] == want[1], (name, list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3], sum(got[1].values()), sum(want[1].values()))
