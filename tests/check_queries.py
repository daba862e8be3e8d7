"""Run registered queries against their SQL on DuckDB: python tests/check_queries.py SF [name ...]"""

import datetime
import decimal
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf, name):
    """None when both sides agree, or what differs."""
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    if [type(v) for row in got[:50] for v in row] != [type(v) for row in want[:50] for v in row]:
        types = [(c, type(a), type(b)) for g, w in zip(got[:50], want[:50])
                 for c, a, b in zip(sorted(columns), g, w) if type(a) is not type(b)]
        if types:
            return f"types {types[:3]}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows instead of {len(want)}; extra {str(extra)[:600]}; missing {str(missing)[:600]}"
    return None


def connect(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def session(cpus=8):
    return (SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con, bad = session(), connect(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in wanted:
        start = time.time()
        try:
            fault = compare(spark, con, sf, name)
        except Exception:
            fault = traceback.format_exc()[-1500:]
        bad += fault is not None
        print(f"{'ok ' if fault is None else 'BAD'} {name} {time.time() - start:.1f}s {fault or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} wrong, {len(entry.oracle_sql())} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
