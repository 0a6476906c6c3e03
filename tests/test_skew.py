"""One key holding most of the rows: same results, no group gathered whole."""

from collections import Counter

import pytest
from helpers import physical, row_set, rows
from pyspark.sql import functions as F

from millrace.operators.aggregates import count_by
from millrace.operators.joins import inner_join, join_count
from millrace.sinks.widecolumn import put_cells


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id"))
    return spark.range(0, 30_000, 1, 6).select(key.cast("bigint").alias("k"), F.col("id").alias("v"))


def test_counts(hot):
    assert dict(rows(count_by(hot, ["k"])))[0] == 20_000


def test_join_count_squares_the_hot_key_without_listing_it(hot):
    keys = Counter(0 if i % 3 < 2 else i for i in range(30_000))
    assert rows(join_count(hot, hot, "k")) == [(sum(n * n for n in keys.values()),)]


def test_join_on_a_hot_key(spark, hot):
    names = spark.range(0, 30_000).select(F.col("id").alias("k"), F.hex("id").alias("name"))
    joined = inner_join(hot, names, "k")
    assert joined.count() == 30_000
    assert row_set(joined.where("v < 3").select("v", "name")) == [(0, "0"), (1, "0"), (2, "2")]


def test_hot_row_is_reduced_before_the_shuffle(hot):
    puts = hot.select(F.lit("row").alias("rowkey"), F.lit("q").alias("qualifier"), F.hex("v").alias("value"), F.col("v").alias("seq"))
    merged = put_cells(puts)
    assert rows(merged) == [("row", "q", f"{29_999:X}")]
    assert "partial_max" in physical(merged)


def test_split_hot_join_partitions(spark):
    """Adaptive execution cuts the hot partition of a shuffle join into several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(0, 200_000, 1, 8).select(F.lit(7).cast("bigint").alias("k"), F.xxhash64("id").alias("v"))
        left = left.unionByName(spark.range(0, 20_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v")))
        right = spark.range(0, 20_000).select(F.col("id").alias("k"), F.hex("id").alias("name"))
        joined = inner_join(left, right, "k")
        assert len(joined.collect()) == 220_000
        assert "SortMergeJoin(skew=true)" in physical(joined)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
