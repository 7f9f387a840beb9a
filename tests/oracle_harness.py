"""Side-by-side check of registered Spark queries against their DuckDB oracle SQL.

Mirrors the driver's gate: row count, column names, and an order-insensitive
multiset of rows (columns sorted by name, floats compared to 10 significant
digits).  Run ``python tests/oracle_harness.py [names...]`` for a report.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def duck_con(data_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


def run_oracle(con, sql: str):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT",
               "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN"}


def spark_type(dt):
    s = dt.simpleString()
    if s.startswith("decimal"):
        return s.upper().replace(" ", "")
    if s.startswith("array<"):
        return spark_type(dt.elementType) + "[]"
    return SPARK_TYPES.get(s, s.upper())


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, data_dir):
    t0 = time.time()
    df = fn(spark, data_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    cur = con.execute(sql)
    o_cols = [x[0] for x in cur.description]
    o_types = {x[0]: str(x[1]).upper().replace(" ", "") for x in cur.description}
    o_rows = cur.fetchall()
    s_types = {f.name: spark_type(f.dataType).replace(" ", "") for f in df.schema.fields}
    sc, sm = canon(s_cols, s_rows)
    oc, om = canon(o_cols, o_rows)
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(o_rows), "spark_s": round(t1 - t0, 2)}
    if sc != oc:
        res.update(status="COLUMNS", spark_cols=sc, oracle_cols=oc)
    elif len(s_rows) != len(o_rows):
        res.update(status="ROWCOUNT")
    elif sm != om:
        diff_s = list((sm - om).elements())[:3]
        diff_o = list((om - sm).elements())[:3]
        res.update(status="VALUES", spark_only=diff_s, oracle_only=diff_o)
    else:
        tdiff = {c: (s_types.get(c), o_types.get(c)) for c in s_cols if s_types.get(c) != o_types.get(c)}
        res.update(status="ok", **({"type_diff": tdiff} if tdiff else {}))
    return res


def main(argv):
    from fundscope.plans.registry import entries
    from fundscope.session import build_session

    data_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", 8)
    con = duck_con(data_dir)
    ents = entries()
    names = argv or list(ents)
    bad = 0
    for n in names:
        e = ents[n]
        try:
            r = compare(spark, con, n, e.fn, e.sql, data_dir)
        except Exception as ex:  # report and continue
            r = {"name": n, "status": "ERROR", "error": f"{type(ex).__name__}: {str(ex)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
