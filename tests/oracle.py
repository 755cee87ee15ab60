"""Run a registered Spark query and its DuckDB oracle side by side and compare.

Usage: python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys
import time

import duckdb

STRICT = os.environ.get("SOSRANK_STRICT", "0") == "1"  # exact float equality

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 9)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN"}


def type_diff(sdf, con, sql: str) -> dict:
    """Columns whose Spark and DuckDB types differ."""
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dt = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    return {k: (st.get(k), dt.get(k)) for k in set(st) | set(dt) if st.get(k) != dt.get(k)}


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    res["oracle_rows"] = len(orows)
    sc, sr = _rows(scols, srows)
    oc, orr = _rows(ocols, orows)
    tdiff = type_diff(sdf, con, sql)
    if sc != oc:
        res["status"] = f"columns differ: spark={sc} oracle={oc}"
    elif tdiff:
        res["status"] = f"types differ: {tdiff}"
    elif len(sr) != len(orr):
        res["status"] = "row count differs"
    elif sr != orr:
        diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
        res["status"] = f"values differ, e.g. {diff}"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from sosrank.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, os_.get(name))
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"error: {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
