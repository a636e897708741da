"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column match, value-hash match, seconds.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 4) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()[:10] if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, name, build, sql, sf_dir, con, show=3):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(s_rows), oracle=None, secs=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    out = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows),
               cols=sorted(s_cols) == sorted(d_cols), hash=hs == hd, secs=round(t1 - t0, 2))
    if not out["hash"] and show:
        sd, dd = set(ls), set(ld)
        out["spark_only"] = sorted(sd - dd)[:show]
        out["oracle_only"] = sorted(dd - sd)[:show]
        if not out["cols"]:
            out["col_diff"] = (sorted(set(s_cols) - set(d_cols)), sorted(set(d_cols) - set(s_cols)))
        out["col_order"] = sorted(s_cols)
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from furrow.plans.registry import all_queries
    from furrow.plans.spec import wrap_sql
    from furrow.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        sql = wrap_sql(q.sql, q.columns) if q.sql else None
        try:
            r = compare(spark, name, q.build, sql, sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=name, error=repr(e)[:800])
        ok = r.get("hash", r.get("oracle", True) is None) and "error" not in r
        bad += 0 if ok else 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
