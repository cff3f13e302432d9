"""Spark rows against DuckDB rows on the given tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if path.is_dir() else f"create view {t} as select * from '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(float(f"{v:.10g}"))
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in values)


def differences(df, con, sql):
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = set(got[1]), set(want[1])
    return f"{len(got[1])} and {len(want[1])} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
