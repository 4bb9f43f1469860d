"""Compare every query with its SQL on DuckDB. Usage: python tests/oracle.py [sf] [name ...]"""

import decimal
import math
import pathlib
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(tuple(plain(row[at]) for at in order) for row in rows)


def compare(spark, folder, name):
    """None when the query and its SQL agree, else what differs."""
    frame = entry.queries()[name](spark, folder)
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = connection.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} <> {sorted(columns)}"
    types = {
        c[0]: str(c[1]).upper() for c in result.description
    }
    odd = []
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for column, kind in frame.dtypes:
        if same.get(kind) and types[column] not in (same[kind], "STRING" if kind == "string" else "", "NUMBER"):
            odd.append((column, kind, types[column]))
    if got != expected:
        only = sorted(set(got) - set(expected))[:3], sorted(set(expected) - set(got))[:3]
        return f"{len(got)} rows <> {len(expected)} rows; only ours {only[0]}; only SQL {only[1]}"
    if not got:
        return "no rows"
    return f"types {odd}" if odd else None


def main():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        started = time.time()
        try:
            problem = compare(spark, folder, name) if name in entry.oracle_sql() else None
        except Exception as error:  # show the cause and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
