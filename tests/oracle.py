"""Runs a registered query and its SQL oracle and compares them as multisets of rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck(sf_dir).sql(sql)
    want = rows(res.columns, res.fetchall())
    assert sorted(df.columns) == sorted(res.columns), (name, df.columns, res.columns)
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (name, len(bad), bad[:3])
    return df.dtypes, list(zip(res.columns, map(str, res.types)))
