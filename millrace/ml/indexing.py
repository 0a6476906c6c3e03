"""Category to index and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.operators.aggregates import count_by
from millrace.session import cut_lineage


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(label, index)`` by falling frequency, ties by label, for any number of labels.

    Labels are range-sorted over the cluster and numbered inside each partition;
    only the partition sizes, one row per partition, are added up in one place.
    """
    counts = count_by(df.where(F.col(column).isNotNull()), [column], "n")
    ordered = counts.orderBy(F.desc("n"), F.asc(column)).select(F.col(column).alias("label"))
    numbered = cut_lineage(ordered.withColumn("mark", F.monotonically_increasing_id()))
    # monotonically_increasing_id holds the partition in its upper bits, the position in the lower 33.
    part = F.shiftright("mark", 33)
    position = F.col("mark") - F.shiftleft(part, 33)
    placed = numbered.select("label", part.alias("part"), position.alias("position"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.sum("size").over(before).alias("start"))
    return placed.join(starts, "part", "left").select(
        "label", (F.coalesce("start", F.lit(0)) + F.col("position")).alias("index")
    )


def index_round_trip(df: DataFrame, column: str, name: str = "index") -> DataFrame:
    """Add the index of each category and the category read back from it; NULL has neither.

    The categories stay a distributed dictionary that is joined both ways, however many there are.
    """
    restored = f"{column}_restored"
    words = cut_lineage(label_dictionary(df, column))
    forward = words.select(F.col("label").alias(column), F.col("index").alias(name))
    backward = words.select(F.col("index").alias(name), F.col("label").alias(restored))
    known = df.where(F.col(column).isNotNull())
    indexed = known.join(forward, column).join(backward, name)
    indexed = indexed.select(*df.columns, F.col(name).cast("double").alias(name), restored)
    return indexed.unionByName(df.where(F.col(column).isNull()), allowMissingColumns=True)
