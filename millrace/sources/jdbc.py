"""Database tables through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    predicate: Column | str | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table; the predicate runs in the database where the source can push it."""
    df = spark.read.jdbc(url, table, properties=properties or {})
    return df if predicate is None else df.where(predicate)


def split_bounds(
    spark: SparkSession, url: str, table: str, split_col: str, properties: dict[str, str] | None = None
) -> tuple[int, int] | None:
    """Smallest and largest split key, computed by the database; None for an empty table."""
    ends = read_jdbc(spark, url, table, properties=properties).agg(
        F.min(split_col).alias("low"), F.max(split_col).alias("high")
    )
    low, high = ends.first()
    return None if low is None else (int(low), int(high))


def import_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    out: str,
    columns: list[str] | None = None,
    num_partitions: int = 1,
    split_col: str | None = None,
    predicates: list[str] | None = None,
    sep: str = ",",
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Copy a table into delimited part files and return the files as lines.

    More than one partition needs a numeric ``split_col``, ideally the primary
    key: each task then reads one equal range of it. Where values crowd into few
    ranges, give ``predicates`` instead, one disjoint condition per task, for
    instance on a remainder of the key.
    """
    from millrace.sinks.files import ctas_delimited

    if num_partitions > 1 and split_col is None and predicates is None:
        raise ValueError("a parallel import needs split_col or predicates")
    bounds = None
    if num_partitions > 1 and predicates is None:
        bounds = split_bounds(spark, url, table, split_col, properties)
    if predicates:
        df = spark.read.jdbc(url, table, predicates=predicates, properties=properties or {})
    elif bounds is None:
        df = read_jdbc(spark, url, table, properties=properties)
    else:
        df = spark.read.jdbc(
            url,
            table,
            column=split_col,
            lowerBound=bounds[0],
            upperBound=bounds[1] + 1,
            numPartitions=num_partitions,
            properties=properties or {},
        )
    ctas_delimited(df.select(*columns) if columns else df, out, sep)
    return spark.read.text(out)
