"""Runs registered queries next to their SQL in DuckDB and compares whole results.

Usage: python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf{}"


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET memory_limit='8GB'")
    for path in glob.glob(f"{DATA.format(sf)}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = rows_of(want_names, res.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(want_names)}", sum(got.values())
    if got != want:
        only_s, only_w = list((got - want).elements()), list((want - got).elements())
        return (f"rows spark {sum(got.values())} sql {sum(want.values())}; only spark {len(only_s)} {only_s[:3]}; "
                f"only sql {len(only_w)} {only_w[:3]}"), sum(got.values())
    return None, sum(got.values())


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oracle-checkpoint-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = queries[name](spark, DATA.format(sf))
            if name in oracles:
                t1 = time.time()
                problem, n = compare(df, con, oracles[name])
            else:
                n = df.count()
                problem = None
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} rows={n} {time.time() - t0:.1f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
