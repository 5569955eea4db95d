"""Run registered queries next to their SQL on one data folder: python tests/compare.py [sf] [pattern]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_SECONDS = 0.0
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return type(a) is type(b) and a == b


def compare(spark, con, sf, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    c1, r1 = rows_of(df.columns, df.collect())
    global SPARK_SECONDS
    SPARK_SECONDS = time.time() - t
    if sql is None:
        return f"rows only: {len(r1)}" if r1 else "EMPTY"
    cur = con.execute(sql)
    c2, r2 = rows_of([d[0] for d in cur.description], cur.fetchall())
    if c1 != c2:
        return f"COLUMNS {c1} != {c2}"
    if len(r1) != len(r2):
        return f"ROWS {len(r1)} != {len(r2)}: {r1[:2]} | {r2[:2]}"
    if not r1:
        return "EMPTY"
    bad = [(a, b) for a, b in zip(r1, r2) if not close(a, b)]
    if bad:
        return f"DIFF {len(bad)}/{len(r1)} cols={c1}: {bad[0][0]} | {bad[0][1]}"
    return f"ok {len(r1)}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from trialgrid.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    pats = (sys.argv[2] if len(sys.argv) > 2 else "").split(",")
    spark, con = local_session(8), duck(sf)
    qs, oracle = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        skip = [x for x in os.environ.get("SKIP", "").split(",") if x]
        if any(p in name for p in pats) and not any(x in name for x in skip):
            t = time.time()
            try:
                res = compare(spark, con, sf, fn, oracle.get(name))
            except Exception as e:
                res = "ERROR " + str(e)[:700]
            good = res.startswith(("ok", "rows only"))
            fails += not good
            print(f"{'  ' if good else '!!'} {name:36s} {SPARK_SECONDS:6.2f}s of {time.time() - t:6.2f}s {res}", flush=True)
    print("failures", fails)
