"""Run registered queries next to their checking SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def database(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple((type(r[i]).__name__ if r[i] is not None else "", _cell(r[i])) for i in order) for r in rows)


def compare(spark, con, name, query, sql, directory):
    """Return (problem text or None, rows, seconds)."""
    t = time.time()
    df = query(spark, directory)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return None, len(got), took
    t2 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), took
    if time.time() - t2 > 3:
        print(f"    (checking SQL took {time.time() - t2:.1f}s)")
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return None, len(got), took
    in_a, in_b = set(a), set(b)
    only_a = [x for x in a if x not in in_b][:2]
    only_b = [x for x in b if x not in in_a][:2]
    cols = sorted(names)
    fmt = lambda x: {c: (v[0], v[1][:160]) for c, v in zip(cols, x)}
    return f"rows {len(a)} vs {len(b)}\n   spark: {[fmt(x) for x in only_a]}\n   check: {[fmt(x) for x in only_b]}", len(got), took


def main(argv):
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from attesta.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    directory = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = database(directory)
    checks, bad = oracle_sql(), 0
    for name, q in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            problem, n, took = compare(spark, con, name, q, checks.get(name), directory)
        except Exception as e:  # report and go on with the other queries
            problem, n, took = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0
        bad += problem is not None
        print(f"{'BAD ' if problem else ('ok  ' if name in checks else 'rows')} {name:30s} rows={n:<7d} {took:6.2f}s", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
