"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import decimal
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return str(v)


def rows(names, data):
    return sorted(tuple(plain(r[n]) for n in names) for r in data)


def differences(df, con, sql):
    names = sorted(df.columns)
    got = rows(names, [r.asDict() for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == names
    want = rows(names, [dict(zip(cols, r, strict=True)) for r in res.fetchall()])
    return [x for x in zip(got, want, strict=False) if x[0] != x[1]] + ([] if len(got) == len(want) else [(len(got), len(want))])
