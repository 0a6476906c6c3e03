"""SequenceFile tables: NULL keys, one delimited text value per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.sources.delimited import typed_fields

# The default field separator of delimited table storage, and the classes of keys and values.
FIELD_SEPARATOR = "\x01"
KEY_CLASS = "org.apache.hadoop.io.NullWritable"
VALUE_CLASS = "org.apache.hadoop.io.Text"


def read_sequencefile(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = FIELD_SEPARATOR
) -> DataFrame:
    """Rows of a SequenceFile table.

    Spark has no DataFrame reader for the format. The values are read as Hadoop texts, which
    become a DataFrame of their bytes; everything stays in the JVM.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    context = spark.sparkContext
    kind = context._jvm.java.lang.Class.forName
    values = context._jsc.sequenceFile(path, kind(KEY_CLASS), kind(VALUE_CLASS)).values()
    texts = DataFrame(spark._jsparkSession.createDataFrame(values, kind(VALUE_CLASS)), spark)
    lines = texts.select(F.expr("CAST(substring(bytes, 1, length) AS STRING)").alias("value"))
    return typed_fields(lines, schema, sep, escaped=True)


def write_sequencefile(df: DataFrame, path: str, sep: str = FIELD_SEPARATOR) -> None:
    """Store ``df`` as a SequenceFile table.

    No public DataFrame writer makes the format, so finished lines are handed over one by one.
    """
    from millrace.sinks.files import delimited_line

    lines = df.select(delimited_line(df, sep))
    lines.rdd.map(lambda row: (None, row[0])).saveAsSequenceFile(path)
