"""Inner equi-joins. Catalyst picks broadcast or shuffle from the measured sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

On = str | tuple[str, str]


def _keys(on: On) -> tuple[str, str]:
    return (on, on) if isinstance(on, str) else on


def inner_join(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """All columns of both sides, one row per matching pair.

    Right columns whose name is taken get the suffix ``_right``, so the result can
    be written. No side is hinted: a side is broadcast only while its estimated
    size is under ``spark.sql.autoBroadcastJoinThreshold``, anything larger is a
    shuffle join whose skewed partitions adaptive execution splits.
    """
    left_key, right_key = _keys(on)
    taken = set(left.columns)
    renamed = right.select(*[F.col(f"`{c}`").alias(f"{c}_right" if c in taken else c) for c in right.columns])
    right_key = f"{right_key}_right" if right_key in taken else right_key
    return left.join(renamed, F.col(f"`{left_key}`") == F.col(f"`{right_key}`"), "inner")


def store_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """Store a table dealt into ``buckets`` by a hash of ``key`` and sorted by it; returns its name.

    Tables that are joined on their keys again and again pay for the shuffle once. All rows of a key
    are in one bucket, so a key with a large share of the rows is better joined unbucketed.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, F.col(f"`{key}`"))
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return name


def join_bucketed(spark: SparkSession, left: str, right: str, on: On) -> DataFrame:
    """Inner join of two stored tables bucketed by their keys into equally many buckets: nothing is shuffled."""
    return inner_join(spark.table(left).hint("merge"), spark.table(right), on)


def join_count(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """Number of matching pairs, as ``n``, without producing the pairs.

    Each side is first counted per key, so a key holding a third of both sides
    costs one row in the shuffle and one multiplication instead of its square.
    """
    left_key, right_key = _keys(on)

    def per_key(df: DataFrame, key: str, count: str) -> DataFrame:
        keys = df.select(F.col(f"`{key}`").alias("k")).where(F.col("k").isNotNull())
        return keys.groupBy("k").agg(F.count(F.lit(1)).alias(count))

    pairs = per_key(left, left_key, "l").join(per_key(right, right_key, "r"), "k")
    return pairs.agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).cast("bigint").alias("n"))
