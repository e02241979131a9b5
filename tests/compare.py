"""Rows of a query and of its SQL, made comparable."""

import datetime
import decimal
import glob
import os


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def same(df, connection, sql):
    columns = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    rel = connection.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
