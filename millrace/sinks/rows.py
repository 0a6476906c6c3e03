"""Row-level changes on file-backed tables and views."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def append_rows(df: DataFrame, target: str, schema: StructType | str, fmt: str = "parquet") -> None:
    """Append rows to a stored table, cast to its column types.

    Columns match by position, like INSERT without a column list. Text that does
    not parse as the declared type is stored as NULL.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} values for {len(schema.fields)} columns")
    cast = [
        F.col(f"`{name}`").try_cast(field.dataType).alias(field.name)
        for name, field in zip(df.columns, schema.fields)
    ]
    df.select(*cast).write.format(fmt).mode("append").save(target)


def append_view(spark: SparkSession, view: str, rows: DataFrame | list) -> DataFrame:
    """Add rows to a registered view; readers of the name see old and new rows."""
    current = spark.table(view)
    if not isinstance(rows, DataFrame):
        rows = spark.createDataFrame(rows, current.schema)
    grown = current.unionByName(rows)
    grown.createOrReplaceTempView(view)
    return grown


def update_where(df: DataFrame, condition: Column, assignments: dict[str, object]) -> DataFrame:
    """UPDATE ... SET ... WHERE as a new DataFrame. Rows whose condition is NULL stay."""
    changed = {}
    for name, value in assignments.items():
        value = value if isinstance(value, Column) else F.lit(value)
        kind = df.schema[name].dataType
        changed[name] = F.when(condition, value.cast(kind)).otherwise(F.col(name))
    return df.withColumns(changed)


def overwrite_snapshot(df: DataFrame, folder: str, fmt: str = "orc") -> str:
    """Write the state after an update beside the old one and return its path.

    The source stays readable until the caller switches over, so the job can read
    and replace the same table and a failed run changes nothing.
    """
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.format(fmt).save(path)
    return path
