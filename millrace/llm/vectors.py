"""What the operators on vectors share: integer codes and blocks of rows as matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Bytes of one Arrow batch of blocks that a worker holds.
BATCH_BYTES = 32 * 1024 * 1024


def usable(vector: str) -> Column:
    """The vector is there and every component is a finite number."""
    whole = F.forall(
        F.col(f"`{vector}`"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.coalesce(whole, F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component x, as longs."""
    return F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def in_parts(codes: str, parts: int, width: int) -> Column:
    """The codes as ``parts`` consecutive arrays of ``width``; missing components are zeros."""
    missing = F.array_repeat(F.lit(0).cast("bigint"), F.lit(parts * width) - F.size(codes))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(F.concat(codes, missing), p * width + 1, F.lit(width)))


def n_blocks(n: int, per_block: int) -> int:
    return max(1, math.ceil(n / per_block))


def blocks(rows: DataFrame, blocks_of: int, parts: int, width: int, *more: str) -> DataFrame:
    """``block, rows, <more...>, parts``: rows dealt to blocks by a hash of their unique ``row``.

    ``parts`` holds for each part the codes of all rows of the block, one row after the other.
    A block has about as many rows as any other, whatever the data hold.
    """
    cut = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks_of)).alias("block"),
        F.struct("row", *more, in_parts("codes", parts, width).alias("cut")).alias("one"),
    )
    grouped = cut.groupBy("block").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return grouped.select(
        "block",
        F.col("all.row").alias("rows"),
        *[F.col(f"all.{name}").alias(f"{name}s") for name in more],
        F.transform(
            F.sequence(F.lit(0), F.lit(parts - 1)),
            lambda p: F.flatten(F.transform("all", lambda r: r["cut"][p])),
        ).alias("parts"),
    )


def flat(column: pa.Array, at: int) -> np.ndarray:
    """The values of one list of a list column, as an array."""
    return column[at].values.to_numpy(zero_copy_only=False)


def bound_batches(spark) -> None:
    """Let no Arrow batch of blocks grow past a number of bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(BATCH_BYTES))
