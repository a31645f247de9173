"""Runs queries next to their SQL, as the driver does: rows as multisets, columns by name."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return int(x) if isinstance(x, int) and not isinstance(x, bool) else x


def compare(df, db, sql):
    rel = db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns), (names, rel.columns)
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
