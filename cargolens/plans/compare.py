"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Comparison mirrors the driver's gate: same column names (sorted), same row
count, and the same multiset of rows. Doubles are compared after rounding
to 9 significant digits, so the check is about values, not the last bit.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations")


def duck(sf_dir: str):
    import duckdb
    import os
    con = duckdb.connect()
    for n in DRIVER_VIEWS:
        p = f"{sf_dir}/{n}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
                 "timestamp": "TIMESTAMP"}


def type_family(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return "DECIMAL"
    return SPARK_TO_DUCK.get(spark_type, spark_type.upper())


def duck_family(duck_type) -> str:
    t = str(duck_type).upper()
    return "DECIMAL" if t.startswith("DECIMAL") else t


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    body = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, body


def compare_one(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    sc, sb = canon(sdf.columns, srows)
    dc, db = canon(dcols, drows)
    stypes = {n: type_family(t) for n, t in sdf.dtypes}
    dtypes = {d[0]: duck_family(d[1]) for d in res.description}
    tdiff = {n: (stypes[n], dtypes.get(n)) for n in stypes if stypes[n] != dtypes.get(n)}
    ok = sc == dc and sb == db and not tdiff
    detail = ""
    if sc != dc:
        detail = f"columns spark={sc} duck={dc}"
    elif tdiff:
        detail = f"types differ {tdiff}"
    elif len(sb) != len(db):
        detail = f"rows spark={len(sb)} duck={len(db)}"
    elif sb != db:
        diff = [(a, b) for a, b in zip(sb, db) if a != b][:3]
        detail = f"values differ e.g. {diff}"
    return ok, len(srows), t1 - t0, t2 - t1, detail


def main(argv=None):
    argv = argv or sys.argv[1:]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    from cargolens.plans.registry import oracle_sql, queries
    from cargolens.session import get_session
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"-- {name}: no oracle, {n} rows ({time.time() - t0:.1f}s)")
            continue
        try:
            ok, n, ts, td, detail = compare_one(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as e:  # report and continue
            ok, n, ts, td, detail = False, -1, 0, 0, f"{type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name}: {n} rows spark {ts:.1f}s duck {td:.1f}s {detail}")
    print(f"{bad} mismatches")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
