"""Compares queries with their SQL on whole tables."""

import datetime
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connection(d: str = SF):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(d).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def differences(spark, query, sql: str, d: str = SF):
    df = query(spark, d)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = connection(d).sql(sql)
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in res.fetchall()]

    def plain(row):
        return tuple(round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v for v in row)

    got, want = sorted(map(plain, got), key=str), sorted(map(plain, want), key=str)
    return [x for x in zip(got, want) if x[0] != x[1]][:3] + [(len(got), len(want))] * (len(got) != len(want))
