"""Compare registered queries with their SQL, the way a reader of both results would."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgergraph.sources.tables import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅" if v is None else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    """(ok, message, spark seconds, sql seconds)"""
    t0 = time.time()
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL", t1 - t0, 0.0
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    t2 = time.time()
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", t1 - t0, t2 - t1
    if got != want:
        a, b = set(got), set(want)
        return False, (f"{len(got)} vs {len(want)} rows; only spark {sorted(a - b)[:2]}; "
                       f"only sql {sorted(b - a)[:2]}"), t1 - t0, t2 - t1
    return True, f"{len(got)} rows", t1 - t0, t2 - t1


def main(argv):
    import fnmatch

    import __spark_entry__ as e
    from ledgergraph.session import local_session
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(folder)
    checks, bad = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if argv and not any(fnmatch.fnmatch(name, p) for p in argv):
            continue
        try:
            ok, msg, a, b = compare(spark, con, name, fn, checks.get(name), folder)
        except Exception as ex:  # report and go on
            ok, msg, a, b = False, f"{type(ex).__name__}: {str(ex)[:700]}", 0, 0
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {a:6.2f}s {b:6.2f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
