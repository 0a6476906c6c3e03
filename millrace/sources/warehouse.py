"""Warehouse tables behind a connector that takes a ``table`` option."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import MissingConnector


def read_warehouse(spark: SparkSession, table: str, connector: str = "parquet") -> DataFrame:
    """``table`` through ``connector``: a data-source name, or Parquet files as the stand-in."""
    if connector == "parquet":
        return spark.read.parquet(table)
    try:
        return spark.read.format(connector).option("table", table).load()
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error):
            raise MissingConnector(f"no '{connector}' connector on the classpath") from error
        raise
