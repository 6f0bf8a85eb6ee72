"""Run each registered query in Spark and its oracle in DuckDB; compare results.

    python tools/check_oracles.py [sf_dir] [key-prefix ...]

Compares row count, column names and the multiset of rows (values normalised:
decimals and floats to rounded floats, dates/timestamps to ISO text).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return str(v)


def spark_family(dt) -> str:
    name = dt.simpleString()
    if name in ("tinyint", "smallint", "int"):
        return "int32"
    if name == "bigint":
        return "int64"
    if name.startswith("decimal"):
        return name.replace(" ", "")
    if name in ("double", "float"):
        return "float"
    if name.startswith("timestamp"):
        return "timestamp"
    return name


def duck_family(t: str) -> str:
    t = str(t).lower()
    if t in ("integer", "smallint", "tinyint", "int32"):
        return "int32"
    if t in ("bigint", "hugeint", "int64"):
        return "int64"
    if t.startswith("decimal"):
        return t.replace(" ", "")
    if t in ("double", "float"):
        return "float"
    if t.startswith("timestamp"):
        return "timestamp"
    if t == "varchar":
        return "string"
    if t == "boolean":
        return "boolean"
    return t


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, key: str, fn, sql: str | None, con) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    cols = df.columns
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(rows)} (no oracle) {t1 - t0:.1f}s"
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    if sorted(cols) != sorted(ocols):
        return False, f"columns differ: spark={cols} oracle={ocols}"
    idx = [ocols.index(c) for c in cols]
    otypes = {d[0]: duck_family(d[1]) for d in res.description}
    tdiff = [(f.name, spark_family(f.dataType), otypes[f.name]) for f in df.schema.fields
             if spark_family(f.dataType) != otypes[f.name]]
    a = sorted((tuple(norm(v) for v in r) for r in rows), key=repr)
    b = sorted((tuple(norm(r[i]) for i in idx) for r in orows), key=repr)
    if len(a) != len(b):
        return False, f"row count spark={len(a)} oracle={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {diff}"
    note = f" TYPES {tdiff}" if tdiff else ""
    return True, f"rows={len(a)} {t1 - t0:.1f}s{note}"


def main(argv):
    from tollgate.plans import catalog
    from tollgate.session import build_session
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    prefixes = [a for a in argv[1:] if not os.path.isdir(a)]
    if os.environ.get("ORACLE_BARE"):  # a session without tollgate's settings, as a driver may pass one
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false")
                 .config("spark.sql.ansi.enabled", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, orc = catalog.queries(), catalog.oracles()
    bad = 0
    for key, fn in qs.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        try:
            ok, msg = compare(spark, sf_dir, key, fn, orc.get(key), con)
        except Exception as e:  # report and continue
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {key}: {msg}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
