"""Run a query on both engines and compare the rows as multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

DATA = os.environ.get("NEWSLOOM_DATA", "/root/testdata")


def views(con, d: str) -> None:
    for name in sorted(os.listdir(d)):
        if name.endswith(".parquet"):
            at = f"{d}/{name}" + ("/*.parquet" if os.path.isdir(f"{d}/{name}") else "")
            con.execute(f"create or replace view {name[:-8]} as select * from '{at}'")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck_rows(sql: str, d: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    views(con, d)
    cur = con.execute(sql)
    return [x[0] for x in cur.description], cur.fetchall()


def assert_same(df, sql: str, d: str) -> int:
    names, theirs = duck_rows(sql, d)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    cols = sorted(names)
    a = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    at = [names.index(c) for c in cols]
    b = Counter(tuple(plain(r[i]) for i in at) for r in theirs)
    assert a == b, (sum(a.values()), sum(b.values()), list((a - b).items())[:5], list((b - a).items())[:5])
    return sum(a.values())
