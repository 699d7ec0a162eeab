"""Side-by-side check of a registered query against its SQL oracle (DuckDB),
the same comparison the driver makes: row count, column names, and an
order-insensitive multiset of rows with columns sorted by name."""

from __future__ import annotations

import math
import os
import sys
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from divspark.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else repr(round(v, 9))
    if isinstance(v, Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, fn, sql: str, sf_dir: str) -> dict:
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck(sf_dir).sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows),
           "columns_match": sorted(scols) == sorted(dcols)}
    res["values_match"] = res["columns_match"] and _rows(scols, srows) == _rows(dcols, drows)
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = scols, dcols
    elif not res["values_match"]:
        a, b = set(_rows(scols, srows)), set(_rows(dcols, drows))
        res["only_spark"] = [str(x)[:300] for x in list(a - b)[:3]]
        res["only_oracle"] = [str(x)[:300] for x in list(b - a)[:3]]
    return res


if __name__ == "__main__":
    import json
    import time

    import __spark_entry__ as E
    from divspark.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = get_session(shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for n in names or sorted(q):
        if n not in o:
            t = time.time()
            rows = q[n](spark, sf).count()
            print(json.dumps({"name": n, "rows_only": rows, "sec": round(time.time() - t, 2)}))
            continue
        t = time.time()
        try:
            r = compare(spark, n, q[n], o[n], sf)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:800]}
        r["sec"] = round(time.time() - t, 2)
        bad += not r.get("values_match")
        print(json.dumps(r), flush=True)
    print("MISMATCHES", bad)
