"""Distinct counts from theta sketches. A sketch is a BINARY value of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def approx_distinct(df: DataFrame, column: str, lgk: int = 12, name: str = "estimate") -> DataFrame:
    """Estimated number of distinct values, one row."""
    return df.agg(F.theta_sketch_estimate(F.theta_sketch_agg(column, lgk)).alias(name))


def sketch_by(df: DataFrame, keys: list[str], column: str, lgk: int = 12) -> DataFrame:
    """One sketch per group, ``(keys..., sketch)``."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(column, lgk).alias("sketch"))


def partition_sketches(df: DataFrame, keys: list[str], column: str, path: str, lgk: int = 12) -> DataFrame:
    """Sketch each input partition on its own and store the sketches as Parquet.

    Returns the stored ``(keys..., sketch)`` rows, to be merged now or later.
    """
    parts = df.withColumn("_part", F.spark_partition_id())
    sketch_by(parts, ["_part", *keys], column, lgk).drop("_part").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def merge_sketches(sketches: DataFrame, keys: list[str], lgk: int = 12) -> DataFrame:
    """Union stored sketches per group (or over all rows) without touching the raw data."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sketch", lgk).alias("sketch"))


def estimates(sketches: DataFrame, name: str = "estimate") -> DataFrame:
    """Replace each sketch by its estimate."""
    keys = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keys, F.theta_sketch_estimate("sketch").alias(name))
