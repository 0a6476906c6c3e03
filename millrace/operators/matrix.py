"""Two-dimensional arrays as cells ``(i, j, v)``; a cell that is not there is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.sampling import uniform_from
from millrace.sources.generated import range_df


def random_matrix(
    spark: SparkSession, rows: int, cols: int, seed: int = 42, partitions: int | None = None
) -> DataFrame:
    """Dense array of uniform values in [0, 1), a function of position and seed only."""
    return range_df(spark, rows * cols, partitions).select(
        F.expr(f"id div {cols}").alias("i"),
        (F.col("id") % F.lit(cols)).alias("j"),
        uniform_from(F.col("id"), seed).alias("v"),
    )


def from_vectors(df: DataFrame, row: str, values: str) -> DataFrame:
    """Rows of an array column as cells."""
    return df.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v")).select(
        F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.col("v").cast("double")
    )


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add_transpose(m: DataFrame) -> DataFrame:
    """``x + x.T`` in one shuffle: both copies meet by position and are summed."""
    return m.unionByName(transpose(m)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def in_slice(row_step: int, col_start: int) -> Column:
    return (F.col("i") % row_step == 0) & (F.col("j") >= col_start)


def slice2d(m: DataFrame, row_step: int, col_start: int) -> DataFrame:
    """``x[::row_step, col_start:]`` with the original positions.

    Both conditions are on grouping columns, so Catalyst moves them below the
    shuffle of :func:`add_transpose`.
    """
    return m.where(in_slice(row_step, col_start))


def row_mean(m: DataFrame, width: int | None = None, name: str = "mean") -> DataFrame:
    """Mean of each row, over its stored cells or over ``width`` cells counting absent ones as zero."""
    mean = F.avg("v") if width is None else F.sum("v") / F.lit(width)
    return m.groupBy("i").agg(mean.alias(name))


def transpose_add_row_mean(
    m: DataFrame, row_step: int, col_start: int, width: int, name: str = "mean"
) -> DataFrame:
    """Row means of ``(x + x.T)[::row_step, col_start:]``, ``width`` columns wide.

    A mean of sums is a sum of partial sums: the two copies never have to meet cell
    by cell. Tasks add up their own cells per row and only those subtotals are
    shuffled.
    """
    copies = slice2d(m, row_step, col_start).unionByName(slice2d(transpose(m), row_step, col_start))
    return row_mean(copies, width, name)


def rechunk(df: DataFrame, n: int | None = None, *by: str) -> DataFrame:
    """The same rows in ``n`` even partitions, or in as many as the session's shuffles have.

    With columns in ``by``, equal values share a partition.
    """
    return df.repartition(n, *by) if n else df.repartition(*by) if by else df.hint("rebalance")
