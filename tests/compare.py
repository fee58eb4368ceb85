"""Run registered queries next to their SQL on DuckDB and compare the rows.

python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return f"dec{v}"
    if isinstance(v, (dt.date, dt.datetime)):
        return f"time{v}"
    if isinstance(v, float):
        return f"f{v!r}"
    if isinstance(v, int):
        return f"i{v}"
    return f"{type(v).__name__}{v}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, statement: str) -> str | None:
    """None when both sides agree, else what differs."""
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} vs {len(theirs[1])}: {mine[1][:2]} vs {theirs[1][:2]}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{a}\n      vs {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lakewarden.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                n = "ok" if problem is None else "DIFF"
            else:
                problem, n = None, f"rows {df.count()}"
        except Exception as failure:
            problem, n = str(failure)[:700], "ERROR"
        print(f"{name:34s} {n:10s} {time.time() - start:6.2f}s" + (f"\n      {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print("failures", bad)
