"""In-memory and generated relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def local_view(spark: SparkSession, rows: list, schema: StructType | str, name: str) -> DataFrame:
    """A relation from literal rows, registered as a temporary view."""
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(name)
    return df


def range_df(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """``id`` from 0 to n-1, produced inside the tasks."""
    return spark.range(0, n, 1, partitions) if partitions else spark.range(n)


def generate_rows(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Fixed-width sort-benchmark rows: 10-character key, 32-digit row id, 48-character filler.

    Every field is a function of the row number, so partitions can be made
    anywhere and made again.
    """
    return rows_of(range_df(spark, n, partitions))


def rows_of(ids: DataFrame) -> DataFrame:
    """The generated row of every ``id``."""
    digest = F.md5(F.col("id").cast("string"))
    return ids.select(
        F.substring(digest, 1, 10).alias("key"),
        F.lpad(F.hex("id"), 32, "0").alias("rowid"),
        F.repeat(F.substring(digest, 11, 12), 4).alias("filler"),
    )
