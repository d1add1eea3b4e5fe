"""Run registered queries beside their DuckDB oracles and report differences.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{directory}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0 if value == value else "nan"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(
        tuple((type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in rows
    )


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same bag of rows, else a short account."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    sql_rows = result.fetchall()
    rows = spark_df.collect()
    if sorted(spark_df.columns) != sorted(sql_columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_columns)}"
    ours, theirs = rows_of(spark_df.columns, rows), rows_of(sql_columns, sql_rows)
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"rows {len(rows)} vs {len(sql_rows)}; only spark {sum(only_ours.values())} "
        f"e.g. {[v for _, v in min(only_ours, key=str, default=())]}; only sql "
        f"{sum(only_theirs.values())} e.g. {[v for _, v in min(only_theirs, key=str, default=())]}"
    )


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(directory)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, directory)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                rows = ""
            else:
                problem, rows = None, f"rows-only {len(df.collect())}"
        except Exception as error:  # report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {rows}"
              f"{problem or ''}", flush=True)
    print(f"{len(sys.argv[2:] or queries)} queries, {bad} bad")
