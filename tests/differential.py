"""A query's rows against its SQL's rows."""

import math
import os
from glob import glob

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def compare(spark, query, sql, sf=SF):
    d = duckdb.connect()
    d.execute("SET timezone = 'UTC'")
    for p in glob(f"{sf}/*.parquet"):
        d.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    found = d.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert got == want
