"""Run registered queries on Spark and their SQL on DuckDB and compare the results."""
import decimal
import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TESTDATA = "/root/testdata"


def session(cpus="8"):
    return (SparkSession.builder.master(f"local[{cpus}]").appName("dialoom")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Return (ok, message)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got_names = df.columns
    got = rows_of(got_names, df.collect())
    spent = time.time() - t0
    if sql is None:
        return True, f"{name}: rows-only {len(got)} rows {spent:.1f}s"
    t1 = time.time()
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(want_names, cur.fetchall())
    dspent = time.time() - t1
    if sorted(got_names) != sorted(want_names):
        return False, f"{name}: columns {sorted(got_names)} != {sorted(want_names)}"
    simple = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = [f"{n}:{t}!={want_types[n]}" for n, t in df.dtypes if simple.get(t, want_types[n]) != want_types[n]]
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return False, f"{name}: {len(got)} vs {len(want)} rows\n  cols {sorted(got_names)}\n  spark {extra}\n  duck  {lack}"
    note = (" TYPES " + ",".join(types)) if types else ""
    return True, f"{name}: ok {len(got)} rows spark {spent:.1f}s duck {dspent:.1f}s{note}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf = os.environ.get("SF", "sf0.01")
    want = sys.argv[1:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/{sf}"
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in qs:
        if want and not any(name.startswith(w) for w in want):
            continue
        try:
            ok, msg = compare(spark, con, name, qs[name], oracle.get(name), sf_dir)
        except Exception as ex:  # report and go on with the next query
            ok, msg = False, f"{name}: {type(ex).__name__} {str(ex)[:1500]}"
        bad += not ok
        print(("" if ok else "FAIL ") + msg, flush=True)
    print("failed:", bad)
