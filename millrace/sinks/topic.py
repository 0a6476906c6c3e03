"""Publishing to topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sinks.versions import Versions
from millrace.sources.topic import BROKERS, connector_error


# Offsets of one publish: its number in the upper bits, the row of the task in the lower ones.
EPOCH_BITS = 34


def next_offset(spark: SparkSession, target: str) -> int:
    """The first offset of a new publish to a folder of messages, taken for good.

    Publishes are numbered in a small file beside the messages, so no message is read. A publish that
    fails leaves a gap.
    """
    versions = Versions(spark, target)
    number, _ = versions.current()
    return (versions.publish(number, []) - 1) << EPOCH_BITS


def write_topic(
    df: DataFrame, target: str, value: Column, key: Column | None = None, brokers: str | None = None
) -> None:
    """Append one record per row to a broker topic or a folder of files.

    In a folder, records are numbered by the task that writes them: its number is the partition,
    and offsets go on after those of all earlier publishes. Of two writers at the same time one fails.
    """
    key = (F.lit(None) if key is None else key).cast("string")
    messages = df.select(key.alias("key"), value.cast("string").alias("value"))
    if not brokers:
        place = F.monotonically_increasing_id()
        # The number holds the task in its upper bits and the row in the lower 33.
        within = place - F.shiftleft(F.shiftright(place, 33), 33)
        offset = within + F.lit(next_offset(df.sparkSession, target))
        numbered = messages.select(F.spark_partition_id().alias("partition"), offset.alias("offset"), "key", "value")
        numbered.write.mode("append").parquet(target)
        return
    try:
        messages.write.format("kafka").option(BROKERS, brokers).option("topic", target).save()
    except Exception as error:
        if "Failed to find data source: kafka" in str(error):
            raise connector_error(error) from error
        raise
