"""Compare named queries with their SQL in DuckDB: ``python tests/oracle.py SF_DIR [name ...]``."""

import collections
import datetime
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def compare(df, con, sql):
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = collections.Counter(
        tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    got = collections.Counter(
        tuple(plain(v) for v in r) for r in df.select(*sorted(names)).collect())
    if want == got:
        return None
    return (f"got {got.total()} want {want.total()}\n  extra   {list((got - want))[:3]}"
            f"\n  missing {list((want - got))[:3]}")


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            diff = compare(fn(spark, sf_dir), con, sql) if sql else None
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:800]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - start:.2f}s {diff or ''}",
              flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
