"""Runs every query against DuckDB on one folder of test tables: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, run, sql):
    """None when both sides agree, else what differs."""
    df = run(spark, folder)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = normal(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        a, b = list(set(mine) - set(theirs))[:3], list(set(theirs) - set(mine))[:3]
        return f"{len(mine)} rows against {len(theirs)}; only here {a}; only there {b}"
    return None if mine else "no rows"


if __name__ == "__main__":
    from conftest import session

    import workload

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(folder)
    for name in sys.argv[2:] or workload.RUNS:
        t = time.time()
        try:
            wrong = compare(spark, con, folder, workload.RUNS[name], workload.SQL.get(name))
        except Exception as e:  # noqa: BLE001
            wrong = f"{type(e).__name__} {str(e)[:700]}"
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - t:.1f}s {(wrong or '')[:900]}", flush=True)
