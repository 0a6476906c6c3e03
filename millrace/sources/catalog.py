"""The star-schema tables as a catalog of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The tables of the catalog.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_star_schema(spark: SparkSession, folder: str, register: bool = True) -> dict[str, DataFrame]:
    """Every table in ``folder`` by name, also registered as temporary views."""
    tables = {name: table(spark, folder, name) for name in TABLES}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables
