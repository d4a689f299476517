"""Spark query against DuckDB SQL on the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, sf_dir, fn, sql):
    """A text that says how the two results differ, or None."""
    got = fn(spark, sf_dir)
    rel = connect(sf_dir).sql(sql)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} and {sorted(rel.columns)}"
    a, b = rows_of(got.columns, got.collect()), rows_of(rel.columns, rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {bad[0]}" if bad else None
