"""Compare a registered query with its SQL twin in DuckDB.

Run as a script: ``python tests/oracle.py [sf] [name part ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: repr(r)
    )


def problems(spark, con, fn, sql, sf_dir):
    """None when both engines agree, else a short description."""
    df = fn(spark, sf_dir)
    got_names, got = normal(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_names, want = normal([c[0] for c in res.description], res.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(bad)} rows differ, first {bad[0]}", len(got)
    return None, len(got)


def main():
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from plait.session import clear_scratch, local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = problems(spark, con, fn, sqls[name], sf_dir)
            else:
                problem, n = None, fn(spark, sf_dir).count()
        except Exception as error:
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        took = time.time() - start
        if problem:
            failed += 1
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5} {name:42} rows={n:<8} {took:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
