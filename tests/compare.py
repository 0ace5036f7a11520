"""Compare Spark queries with their SQL on one scale factor.

    python tests/compare.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool):
            return int(v)
        return v
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in r))


def difference(spark_df, con, sql):
    a_cols, a = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    b_cols, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {sorted(set(a_cols) ^ set(b_cols))}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(a)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        cols = [c for i, c in enumerate(a_cols) if any(x[i] != y[i] for x, y in bad)]
        x, y = bad[0]
        return f"{len(bad)}/{len(a)} rows differ in {cols}; e.g. {[(c, x[i], y[i]) for i, c in enumerate(a_cols) if x[i] != y[i]][:4]} key {x[:5]}", len(a)
    types = [(c, type(x).__name__, type(y).__name__) for c, x, y in zip(a_cols, a[0], b[0]) if x is not None and y is not None and type(x) is not type(y)] if a else []
    return (f"types {types}" if types else ""), len(a)


def main():
    from oracles.tails import TAILS, groups
    from oracles import prelude  # noqa: F401
    import oracles.tails as T
    T.oracle_sql()
    from tailcast.plans.catalog import load
    from tailcast.session import local_session
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    queries = load()
    names = [n for n in queries if not args[1:] or any(n.startswith(p) for p in args[1:])]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    ctes, cons = groups(), {}
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n not in TAILS:
                print(f"rows  {n}: {df.count()} rows  {time.time() - t:.1f}s", flush=True)
                continue
            group, sql = TAILS[n]
            if group not in cons:
                con = connect(sf)
                for name, body in ctes[group].items():
                    con.execute(f'CREATE TEMP TABLE "{name}" AS {body}')
                cons[group] = con
            t1 = time.time()
            msg, count = difference(df, cons[group], sql)
            bad += bool(msg)
            print(f"{'DIFF ' if msg else 'ok   '} {n}: {count} rows {time.time() - t:.1f}s {msg}", flush=True)
        except Exception as exc:
            bad += 1
            print(f"FAIL  {n}: {str(exc)[:700]}", flush=True)
            if "-v" in args:
                traceback.print_exc()
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main()
