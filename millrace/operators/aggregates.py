"""Grouping and global aggregates, all with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.sampling import radical_inverse, uniform_from
from millrace.functions.text import words
from millrace.sources.generated import range_df


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows per group; NULL is a group like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_col_by(
    df: DataFrame, keys: list[str], column: str, where: Column | str | None = None, name: str = "n"
) -> DataFrame:
    """Non-NULL values of ``column`` per group, over the rows that pass ``where``."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count(column).alias(name))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def total(df: DataFrame, column: str, name: str = "total") -> DataFrame:
    return df.agg(F.sum(column).alias(name))


def distinct_of(df: DataFrame, expression: Column, name: str = "value") -> DataFrame:
    """Distinct values of a computed column."""
    return df.select(expression.alias(name)).distinct()


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Occurrences of every word, ``(word, n)``. Works on batch and streaming input."""
    return (
        lines.select(F.explode(words(F.col(column))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pi_of_points(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """Four times the share of points inside the quarter circle, as ``(samples, inside, pi)``."""
    inside = F.sum(F.when(x * x + y * y < 1, 1).otherwise(0))
    return (
        points.agg(F.count(F.lit(1)).alias("samples"), inside.alias("inside"))
        .select("samples", "inside", (F.col("inside") * F.lit(4.0) / F.col("samples")).alias("pi"))
    )


def monte_carlo_pi(spark: SparkSession, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Pi from ``n`` pseudo-random points."""
    key = F.col("id")
    return pi_of_points(range_df(spark, n, partitions), uniform_from(key, seed), uniform_from(key, ~seed))


def halton_tallies(points: DataFrame, index: str, group: Column) -> DataFrame:
    """Per map task: Halton points (bases 2 and 3) in and out of the circle of radius one half."""
    x = radical_inverse(F.col(index), 2) - F.lit(0.5)
    y = radical_inverse(F.col(index), 3) - F.lit(0.5)
    outside = F.when(x * x + y * y > F.lit(0.25), 1).otherwise(0)
    return (
        points.groupBy(group.alias("map_id"))
        .agg(F.count(F.lit(1)).alias("points"), F.sum(outside).alias("outside"))
        .select("map_id", (F.col("points") - F.col("outside")).alias("inside"), "outside")
    )


def quasi_pi(spark: SparkSession, maps: int, samples: int) -> DataFrame:
    """Pi from ``maps`` tasks of ``samples`` Halton points each, tallies summed at the end."""
    points = range_df(spark, maps * samples, maps)
    tallies = halton_tallies(points, "id", F.expr(f"id div {samples}"))
    return pi_of_tallies(tallies)


def pi_of_tallies(tallies: DataFrame) -> DataFrame:
    return (
        tallies.agg(F.sum("inside").alias("inside"), F.sum(F.col("inside") + F.col("outside")).alias("samples"))
        .select("samples", "inside", (F.col("inside") * F.lit(4.0) / F.col("samples")).alias("pi"))
    )
