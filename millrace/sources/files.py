"""Columnar, JSON and plain-text readers, and the suffix registry over all formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.sources.sequencefile import read_sequencefile

Schema = StructType | str | None

# File suffix, reader and reader options of every known format.
FORMATS: dict[str, tuple[str, dict[str, object]]] = {
    "csv": ("csv", {"sep": ","}),
    "csvh": ("csv", {"sep": ",", "header": True}),
    "tsv": ("csv", {"sep": "\t"}),
    "tbl": ("csv", {"sep": "|"}),
    "json": ("json", {}),
    "parquet": ("parquet", {}),
    "avro": ("avro", {}),
    "seq": ("sequencefile", {}),
}


class MissingConnector(RuntimeError):
    """A format whose Spark package is not on the classpath."""


def _load(spark: SparkSession, fmt: str, path: str, schema: Schema, **options: object) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_parquet(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    return _load(spark, "parquet", path, schema)


def read_orc(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    return _load(spark, "orc", path, schema)


def read_json(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """JSON documents, one per line. A given schema saves the inference pass."""
    return _load(spark, "json", path, schema)


def read_avro(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """Avro files, through Spark's own external module."""
    try:
        return _load(spark, "avro", path, schema)
    except Exception as error:
        if "Failed to find data source: avro" in str(error):
            raise MissingConnector("add org.apache.spark:spark-avro to read Avro files") from error
        raise


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain text, one row per line in ``value``."""
    return spark.read.text(path)


def suffix_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def read_any(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """Read a file or folder by the format its suffix stands for."""
    suffix = suffix_of(path)
    if suffix not in FORMATS:
        raise ValueError(f"no format is registered for '.{suffix}'; known: {', '.join(FORMATS)}")
    fmt, options = FORMATS[suffix]
    if fmt == "avro":
        return read_avro(spark, path, schema)
    if fmt == "sequencefile":
        return read_sequencefile(spark, path, schema or "value string")
    return _load(spark, fmt, path, schema, **options)
