"""Projection, derivation and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, StringType


def project(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Select ``{new name: old name or expression}``."""
    return df.select(*[(F.col(old) if isinstance(old, str) else old).alias(new) for new, old in mapping.items()])


def derive(df: DataFrame, name: str, expression: Column | str) -> DataFrame:
    """Add a computed column."""
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def filter_eq(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column equals a literal; reaches the scan."""
    return df.where(F.col(column) == F.lit(value))


def filter_date(df: DataFrame, column: str, iso: str) -> DataFrame:
    """Rows of one calendar day.

    Timestamp columns are compared with the two ends of the day instead of being
    cast, so the filter still reaches the Parquet row-group statistics.
    """
    day = dt.date.fromisoformat(iso)
    kind = df.schema[column].dataType
    if isinstance(kind, DateType):
        return df.where(F.col(column) == F.lit(day))
    if isinstance(kind, StringType):
        return df.where(F.col(column).try_cast("date") == F.lit(day))
    start = F.lit(day.isoformat()).cast(kind)
    end = F.lit((day + dt.timedelta(days=1)).isoformat()).cast(kind)
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def split_features(df: DataFrame, label: str, drop: tuple[str, ...] | list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop unwanted columns and name the feature columns: everything but the label."""
    kept = df.drop(*drop)
    return kept, [name for name in kept.columns if name != label]


def as_factor(df: DataFrame, column: str) -> DataFrame:
    """Turn a column into a categorical one, so a learner treats its values as levels."""
    return df.withColumn(column, F.col(column).cast("string"))
