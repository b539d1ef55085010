"""Rows of a Spark query against those of DuckDB."""

import math

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def same(spark, name, query, sql, sf="sf0.001"):
    df = query(spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{DATA}/{sf}/{t}.parquet'")
    relation = con.sql(sql)
    assert sorted(relation.columns) == cols, name
    got = table(df.select(*(f"`{c}`" for c in cols)).collect())
    want = table(relation.select(",".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want, name
