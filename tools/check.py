"""Run registered queries beside their SQL and compare the results.

    python tools/check.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.plans import all_oracles, all_queries  # noqa: E402
from millrace.session import build_session, release_scratch  # noqa: E402
from millrace.sources.catalog import TABLES  # noqa: E402


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value: object) -> object:
    if isinstance(value, float):
        return repr(value) if math.isfinite(value) else str(value)
    if isinstance(value, (int, bool)):
        return value
    return str(value)


def normal_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


# Spark type names and what the same column is called in DuckDB.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def type_differences(df, connection, sql: str) -> list[tuple]:
    """Columns whose type is not the one the SQL gives."""
    want = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return [(c, t, want.get(c)) for c, t in df.dtypes if TYPES.get(t, t) != want.get(c)]


def compare(spark, connection, name: str, folder: str) -> tuple[str, str]:
    df = all_queries()[name](spark, folder)
    got = normal_rows(df.columns, df.collect())
    sql = all_oracles().get(name)
    if sql is None:
        return "ROWS", f"{len(got)} rows {df.columns} {got[:3]}"
    if differences := type_differences(df, connection, sql):
        return "FAIL", f"types {differences}"
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    want = normal_rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return "FAIL", f"{len(got)} rows, expected {len(want)}; extra {extra}; missing {missing}"
    return "ok", f"{len(got)} rows"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(all_queries())
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            status, detail = compare(spark, connection, name, folder)
        except Exception as error:
            status, detail = "FAIL", f"{type(error).__name__}: {str(error)[:900]}"
        failed += status == "FAIL"
        print(f"{status:5} {name:24} {time.time() - start:6.2f}s  {detail}", flush=True)
    release_scratch(spark)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
