"""Run registered queries and their oracles side by side and compare the rows.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, decimal.Decimal)) or (isinstance(value, float) and value == int(value)):
        return str(int(value)) if value == int(value) else f"{float(value):.9g}"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def session(cores=8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(folder, names):
    import __spark_entry__ as contract
    spark, con = session(), connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = []
    for name in names or queries:
        began = time.time()
        try:
            got_names, got = spark_rows(queries[name](spark, folder))
            took = time.time() - began
            if name not in oracles:
                print(f"rows {name} {len(got)} rows {took:.1f}s {got[0] if got else ''}"[:400], flush=True)
                continue
            want_names, want = duck_rows(con, oracles[name])
            same = got_names == want_names and got == want
            print(f"{'ok  ' if same else 'DIFF'} {name} {len(got)}/{len(want)} rows {took:.1f}s", flush=True)
            if not same:
                bad.append(name)
                print("  ", got_names, want_names)
                extra, lack = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
                print("   spark only:", str(extra)[:700], "\n   sql only:  ", str(lack)[:700], flush=True)
        except Exception as problem:
            bad.append(name)
            print(f"FAIL {name} {type(problem).__name__} {str(problem)[:700]}", flush=True)
    print(f"{len(bad)} bad: {bad}")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(1 if main(args[0] if args else "/root/testdata/sf0.01", args[1:]) else 0)
