"""Delimited text and CSV readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from millrace.functions.text import literal_pattern, unescaped

# Fixed value: the text that stands for NULL in delimited table files.
NULL_TEXT = "\\N"


def typed_fields(
    lines: DataFrame, schema: StructType, sep: str, column: str = "value", escaped: bool = False
) -> DataFrame:
    """Split one text column into declared columns, reading bad cells as NULL.

    Missing trailing fields and cells that do not parse give NULL, surplus fields
    are dropped, an empty string stays an empty string. ``escaped`` undoes the backslash
    codes of the writers of this library.
    """
    parts = lines.select(F.split(F.col(column), literal_pattern(sep), -1).alias("parts"))
    columns = []
    for position, field in enumerate(schema.fields):
        cell = F.get(F.col("parts"), F.lit(position))
        cell = F.when(cell != NULL_TEXT, unescaped(cell, sep) if escaped else cell)
        if not isinstance(field.dataType, StringType):
            cell = cell.try_cast(field.dataType)
        columns.append(cell.alias(field.name))
    return parts.select(*columns)


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = ":", escaped: bool = False
) -> DataFrame:
    """Text table with declared columns and a one-character separator, typed on read.

    Rows end at a line feed only; a carriage return is part of the value. ``escaped``
    is for files that :func:`millrace.sinks.files.ctas_delimited` wrote.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return typed_fields(spark.read.option("lineSep", "\n").text(path), schema, sep, escaped=escaped)


def read_csv_infer(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header whose types are inferred from all rows (one extra pass)."""
    return spark.read.options(header=True, inferSchema=True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and declared types: one pass, only the columns in use are parsed."""
    return spark.read.schema(schema).option("header", True).csv(path)
