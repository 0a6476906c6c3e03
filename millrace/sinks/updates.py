"""Updates of stored tables that rewrite only the files with matching rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sinks.rows import update_where
from millrace.sinks.versions import Versions


def _write(df: DataFrame, table: str) -> list[str]:
    """Store rows as new files of the table and name them."""
    folder = f"{table.rstrip('/')}/data-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return sorted(df.sparkSession.read.parquet(folder).inputFiles())


def create_table(df: DataFrame, table: str, clustered_by: list[str] | None = None) -> int:
    """Store a new table and return its version.

    ``clustered_by`` cuts the files by ranges of these columns, so that conditions on them match few files.
    """
    if clustered_by:
        df = df.repartitionByRange(*clustered_by)
    return Versions(df.sparkSession, table).publish(0, _write(df, table))


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the newest version."""
    _, files = Versions(spark, table).current()
    if not files:
        raise FileNotFoundError(f"no table in {table}")
    return spark.read.parquet(*files)


def update_files(
    spark: SparkSession, table: str, condition: Column, assignments: dict[str, object]
) -> tuple[int, int]:
    """UPDATE ... SET ... WHERE; returns how many files were rewritten and how many stayed.

    One scan with the condition pushed down finds the files that hold matching rows. Only these are
    read whole and written anew; the next version names the new files and the untouched ones.
    Rows whose condition is NULL stay. Without a match the version stays too.
    """
    versions = Versions(spark, table)
    number, files = versions.current()
    rows = read_table(spark, table)
    # One name for each matching file, however many rows match in it.
    touched = {row[0] for row in rows.where(condition).select("_metadata.file_name").distinct().collect()}
    old = [file for file in files if file.rsplit("/", 1)[1] in touched]
    kept = [file for file in files if file.rsplit("/", 1)[1] not in touched]
    if not old:
        return 0, len(kept)
    changed = update_where(spark.read.schema(rows.schema).parquet(*old), condition, assignments)
    versions.publish(number, sorted(kept + _write(changed, table)))
    return len(old), len(kept)
