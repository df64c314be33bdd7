"""Run registered queries next to their SQL: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder: str, name: str, fn, sql: str | None) -> str:
    """'' when both sides agree, else what differs."""
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    con = duck(folder)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    con.close()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}: {[r for r in got if r not in want][:2]} / {[r for r in want if r not in got][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return f"{len(bad)} rows differ: {str(bad[:1])[:3000]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from codestrata.session import local_session

    spark = local_session("8")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = compare(spark, sys.argv[1], name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {'D' if name in oracles else 'R'} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)
