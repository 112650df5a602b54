"""Runs queries against their DuckDB equivalents; used by the tests and by hand."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "quantize"):
        return round(float(v), 4) + 0.0
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, int) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str), sorted(names)


def same(df, con, sql):
    names = df.columns
    own = rows(names, df.collect())
    result = con.execute(sql)
    other = rows([c[0] for c in result.description], result.fetchall())
    return own, other
