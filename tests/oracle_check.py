"""Run registered queries against their DuckDB oracle SQL and compare results.

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = "--exact" in sys.argv


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = Counter(tuple(norm(r[i]) for i in si) for r in spark_rows)
    b = Counter(tuple(norm(r[i]) for i in di) for r in duck_rows)
    if len(spark_rows) != len(duck_rows):
        return f"rows differ: {len(spark_rows)} vs {len(duck_rows)}; e.g. {list((a - b).items())[:2]} / {list((b - a).items())[:2]}"
    if a != b:
        return f"values differ: {list((a - b).items())[:2]} / {list((b - a).items())[:2]}"
    return None


def main(argv):
    vanilla = "--vanilla" in argv
    argv = [a for a in argv if a not in ("--vanilla", "--exact")]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    if vanilla:  # a plain session, as a driver would create it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        from lexframe.session import build_session
        spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in (keys or list(qs)):
        t = time.time()
        try:
            df = qs[k](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t
        if k not in sqls:
            print(f"ROWS {k}: {len(rows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sqls[k])
            drows = cur.fetchall()
            dcols = [x[0] for x in cur.description]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        msg = compare(rows, cols, drows, dcols)
        if msg:
            bad += 1
            print(f"FAIL {k}: {msg}")
        else:
            print(f"OK   {k}: {len(rows)} rows {ts:.1f}s")
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
