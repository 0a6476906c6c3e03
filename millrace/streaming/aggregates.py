"""Windowed and running aggregates that work on batch and streaming input alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators.aggregates import word_count


def stream_word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Running word counts of a stream of lines."""
    return word_count(lines, column)


def metric_rollup(
    df: DataFrame,
    interval: str,
    labels: list[str],
    ts: str = "ts",
    value: str = "value",
    lateness: str | None = None,
) -> DataFrame:
    """Count, mean and maximum per fixed interval and label combination.

    ``lateness`` bounds the state of an unending stream; leave it out for complete
    results over everything read. Watermarks need an instant, so a timestamp without
    zone is then read in the session's zone.
    """
    samples = df.select(F.col(ts).alias("ts"), *labels, F.col(value).alias("v"))
    if lateness:
        samples = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return (
        samples.groupBy(F.window("ts", interval), *labels)
        .agg(F.count("v").alias("samples"), F.avg("v").alias("mean"), F.max("v").alias("peak"))
        .select(F.col("window.start").alias("window_start"), *labels, "samples", "mean", "peak")
    )
