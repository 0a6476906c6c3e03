"""Cell upserts for wide-column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def put_cells(cells: DataFrame) -> DataFrame:
    """Merge puts ``(rowkey, qualifier, value, seq)``: the latest put of each cell wins.

    Equal ``seq`` values resolve to the larger value, so a rerun gives the same table.
    """
    return (
        cells.groupBy("rowkey", "qualifier")
        .agg(F.max(F.struct("seq", "value")).alias("put"))
        .select("rowkey", "qualifier", F.col("put.value").alias("value"))
    )


def store_cells(cells: DataFrame, path: str) -> None:
    """Store merged cells, one record per cell whatever the width of its row."""
    cells.select("rowkey", "qualifier", "value").write.parquet(path)


def import_columns(df: DataFrame, key: str, columns: list[str], seq: str) -> DataFrame:
    """Relational rows as puts: one cell per non-NULL column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("qualifier"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.col(key).cast("string").alias("rowkey"), F.col(seq).alias("seq"), F.inline(pairs))
        .where(F.col("value").isNotNull())
        .select("rowkey", "qualifier", "value", "seq")
    )
