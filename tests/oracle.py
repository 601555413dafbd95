"""Runs a query's SQL in DuckDB over the driver tables and compares rows without regard to order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, con, text):
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    expected = rows(names, cur.fetchall())
    found = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert sorted(names) == sorted(spark_df.columns), (sorted(names), sorted(spark_df.columns))
    assert len(found) == len(expected), (len(found), len(expected))
    for a, b in zip(found, expected, strict=True):
        same = all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))
        assert same, (a, b)
