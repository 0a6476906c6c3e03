"""Wide-column tables: a row key and a sparse family of ``qualifier -> value`` cells.

The canonical form is one record per cell ``(rowkey, qualifier, value)``: it has
no widest row to fit in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.sources.delimited import read_delimited


def read_widecolumn(spark: SparkSession, path: str) -> DataFrame:
    """One family as stored: a record ``(rowkey, qualifier, value)`` per cell."""
    return spark.read.parquet(path)


def row_keys(cells: DataFrame) -> DataFrame:
    """``(rowkey, cells)`` with the number of cells of every row."""
    return cells.groupBy("rowkey").agg(F.count(F.lit(1)).alias("cells"))


def cells_of(rows: DataFrame) -> DataFrame:
    """One record per cell from rows ``(rowkey, cf MAP)``, as the bulk load makes them."""
    return rows.select("rowkey", F.explode("cf").alias("qualifier", "value"))


def import_tsv(
    spark: SparkSession, path: str, columns: list[str], key: str, seq: str, sep: str = "\t", escaped: bool = True
) -> DataFrame:
    """Bulk-load delimited text into keyed rows ``(rowkey, cf MAP)``.

    ``columns`` names the fields in file order; ``key`` is the row key and ``seq``
    the write order (a whole number). The remaining fields become cells; for each
    cell the last non-NULL write of its row wins, equal ``seq`` values by the larger
    text. Grouping keeps one candidate per cell, so a hot key is reduced before
    the shuffle. The maximum of a number and a text sorts each task's rows first.
    ``escaped`` undoes backslash codes.
    """
    schema = StructType([StructField(name, StringType()) for name in columns])
    lines = read_delimited(spark, path, schema, sep, escaped).where(F.col(key).isNotNull())
    lines = lines.withColumn(seq, F.col(seq).try_cast("bigint"))
    qualifiers = [name for name in columns if name not in (key, seq)]
    latest = [
        F.max(F.when(F.col(q).isNotNull(), F.struct(F.col(seq), F.col(q)))).alias(q) for q in qualifiers
    ]
    entries = [F.struct(F.lit(q).alias("key"), F.col(f"{q}.{q}").alias("value")) for q in qualifiers]
    present = F.filter(F.array(*entries), lambda entry: entry["value"].isNotNull())
    return (
        lines.groupBy(F.col(key).alias("rowkey"))
        .agg(*latest)
        .select("rowkey", F.map_from_entries(present).alias("cf"))
    )
