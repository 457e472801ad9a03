"""Comparing a query with its SQL on the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks notes note_feed ingest_runs query_vecs candidates gold_cases".split()


def connect(folder):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def compare(spark, query, sql, folder):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = connect(folder).execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == want
