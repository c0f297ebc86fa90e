"""Runs a query and its SQL side by side; compares columns by name and rows without order."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return int(v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()], key=repr)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in cur.fetchall()], key=repr)


def difference(spark, sf_dir, con, f, sql) -> str | None:
    a, x = rows_of_spark(f(spark, sf_dir))
    b, y = rows_of_duck(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        s, t = set(map(repr, x)), set(map(repr, y))
        return f"rows {len(x)} and {len(y)}; only here {list(s - t)[:4]}; only SQL {list(t - s)[:4]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tapeloom.session import local_session

    spark, d = local_session(os.environ.get("CORES", "4")), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01")
    con, q, o = connect(d), e.queries(), e.oracle_sql()
    for name in sys.argv[1:] or [n for n in q if not n.startswith("p")]:
        t = time.time()
        try:
            if name in o:
                r = difference(spark, d, con, q[name], o[name]) or "same"
            else:
                df = q[name](spark, d)
                r = f"{df.count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            r = f"ERROR {str(x)[:600]}"
        print(f"{name}: {r} ({time.time() - t:.1f} s)", flush=True)
