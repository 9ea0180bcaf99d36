"""Compare a registered query with its SQL oracle, as multisets of rows."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def compare(spark, name, query, sql, sf_dir=f"{DATA}/sf0.01"):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    want = tables(sf_dir).sql(sql)
    assert sorted(want.columns) == names, (name, want.columns, names)
    at = [want.columns.index(n) for n in names]
    rows = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert len(got) == len(rows), (name, len(got), len(rows), [x for x in got if x not in rows][:3], [x for x in rows if x not in got][:3])
    for a, b in zip(got, rows, strict=True):
        assert a == b, (name, a, b)
    return len(rows)
