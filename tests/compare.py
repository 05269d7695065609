"""Run catalogue queries against their SQL on the same Parquet files."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else (None if math.isnan(value) else value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def run(spark, con, folder, fn, sql):
    """(problem or None, number of rows, seconds Spark took)."""
    start = time.time()
    df = fn(spark, folder)
    columns, rows = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, len(rows), took
    result = con.sql(sql)
    kinds = dict(zip(result.columns, [str(t) for t in result.types], strict=True))
    want_columns, want = table(result.columns, result.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}", len(rows), took
    names = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {n: (names.get(t, t), kinds[n]) for n, t in df.dtypes if names.get(t, t) != kinds[n]}
    if types:
        return f"types {types}", len(rows), took
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}", len(rows), took
    bad = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    return (f"{len(bad)} rows differ, first {bad[0]}" if bad else None), len(rows), took


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rankloom-compare-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = E.oracle_sql()
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        try:
            problem, n, took = run(spark, con, folder, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        state = "ok " if problem is None else "BAD"
        print(f"{state} {name:24s} rows={n:7d} {took:6.2f}s {'' if sqls.get(name) else '(no sql) '}{problem or ''}", flush=True)
