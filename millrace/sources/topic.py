"""Append-only topics: a broker topic, or a folder of Parquet files as the stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources.files import MissingConnector

# Fixed value: the record layout of a topic kept in files.
MESSAGE_SCHEMA = "partition INT, offset BIGINT, key STRING, value STRING"
BROKERS = "kafka.bootstrap.servers"


def connector_error(error: Exception) -> MissingConnector:
    return MissingConnector("add org.apache.spark:spark-sql-kafka-0-10 to use broker topics")


def read_topic(
    spark: SparkSession, source: str, brokers: str | None = None, max_files: int | None = None
) -> DataFrame:
    """A streaming DataFrame ``(partition, offset, key, value)`` over the whole topic, earliest record first.

    Offsets grow within a partition and are never used twice; gaps are possible.
    ``max_files`` (files) bounds one micro-batch of a long backlog; a broker
    topic is bounded by its own ``maxOffsetsPerTrigger``.
    """
    if brokers:
        reader = (
            spark.readStream.format("kafka")
            .option(BROKERS, brokers)
            .option("subscribe", source)
            .option("startingOffsets", "earliest")
        )
        try:
            return reader.load().selectExpr(
                "partition", "offset", "CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value"
            )
        except Exception as error:
            if "Failed to find data source: kafka" in str(error):
                raise connector_error(error) from error
            raise
    stream = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return stream.parquet(source)


def read_offsets(spark: SparkSession, source: str, partition: int, first: int = 0, before: int | None = None) -> DataFrame:
    """Records of one partition of a topic kept in files, from an offset on and below another, in their order.

    Both conditions reach the statistics of the files.
    """
    records = spark.read.schema(MESSAGE_SCHEMA).parquet(source)
    records = records.where((F.col("partition") == partition) & (F.col("offset") >= first))
    if before is not None:
        records = records.where(F.col("offset") < before)
    return records.orderBy("offset")
