"""Compare a query with its SQL twin as the driver does: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "null" if v is None else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def differs(spark, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    a = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    b = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} rows, oracle {len(b)}: {diff}"
    return ""
