"""A wide-column store that takes puts and deletes for as long as it lives.

The store is a set of sorted runs. Every batch of puts becomes one more run, cut into files by ranges
of (row key, qualifier) and sorted by them, so nothing that is stored is read or rewritten.
Readers merge the runs: of each cell the write with the largest ``seq`` counts. The row-key
condition of a reader reaches the file statistics of every run. ``compact`` merges all runs into one and
forgets what was deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sinks.versions import Versions

# A qualifier is the family, this sign, and the name of the column.
FAMILY_SIGN = ":"


def _store_run(cells: DataFrame, store: str) -> str:
    path = f"{store.rstrip('/')}/run-{uuid.uuid4().hex}"
    ranges = cells.select("rowkey", "qualifier", "value", "seq").repartitionByRange("rowkey", "qualifier")
    ranges.sortWithinPartitions("rowkey", "qualifier").write.parquet(path)
    return path


def _latest(cells: DataFrame) -> DataFrame:
    """The last write of every cell. At the same ``seq`` a delete wins over a put, then the larger value."""
    last = F.max(F.struct("seq", F.col("value").isNull().alias("gone"), "value")).alias("last")
    return cells.groupBy("rowkey", "qualifier").agg(last).select("rowkey", "qualifier", "last.value", "last.seq")


def put(cells: DataFrame, store: str) -> int:
    """Add a batch ``(rowkey, qualifier, value, seq)`` as a run; returns the new version.

    A null ``value`` deletes the cell, a null ``qualifier`` the whole row as written up to ``seq``.
    """
    versions = Versions(cells.sparkSession, store)
    number, runs = versions.current()
    return versions.publish(number, [*runs, _store_run(_latest(cells), store)])


def bulk_load(rows: DataFrame, store: str, seq: int) -> int:
    """Load keyed rows ``(rowkey, cf MAP)`` as one run, all written at ``seq``.

    Split points are sampled from the keys, and each file of the run holds a range of them in total order.
    """
    cells = rows.select("rowkey", F.explode("cf").alias("qualifier", "value"), F.lit(seq).cast("bigint").alias("seq"))
    return put(cells, store)


def delete_rows(keys: DataFrame, store: str) -> int:
    """Delete the rows ``(rowkey, seq)`` as written up to ``seq``."""
    none = F.lit(None).cast("string")
    return put(keys.select("rowkey", none.alias("qualifier"), none.alias("value"), "seq"), store)


def _merged(cells: DataFrame) -> DataFrame:
    last = _latest(cells.where(F.col("qualifier").isNotNull())).where(F.col("value").isNotNull())
    gone = cells.where(F.col("qualifier").isNull()).groupBy("rowkey").agg(F.max("seq").alias("gone"))
    return last.join(gone, "rowkey", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).drop("gone")


def scan(spark: SparkSession, store: str, rows: Column | None = None, family: str | None = None) -> DataFrame:
    """The cells ``(rowkey, qualifier, value, seq)`` as they stand now.

    ``rows`` is a condition on ``rowkey`` and is applied to every run before they are merged.
    """
    _, runs = Versions(spark, store).current()
    if not runs:
        raise FileNotFoundError(f"no store in {store}")
    cells = spark.read.parquet(*runs)
    if rows is not None:
        cells = cells.where(rows)
    if family is not None:
        whole_row = F.col("qualifier").isNull()
        cells = cells.where(whole_row | F.col("qualifier").startswith(family + FAMILY_SIGN))
    return _merged(cells)


def get_row(spark: SparkSession, store: str, key: str, family: str | None = None) -> DataFrame:
    """The cells of one row."""
    return scan(spark, store, F.col("rowkey") == key, family)


def get_rows(spark: SparkSession, store: str, first: str, before: str, family: str | None = None) -> DataFrame:
    """The cells of the rows from ``first`` on and below ``before``."""
    return scan(spark, store, (F.col("rowkey") >= first) & (F.col("rowkey") < before), family)


def run_count(spark: SparkSession, store: str) -> int:
    return len(Versions(spark, store).current()[1])


def compact(spark: SparkSession, store: str) -> int:
    """Merge all runs into one and return the new version. Readers of the old runs can go on."""
    versions = Versions(spark, store)
    number, _ = versions.current()
    return versions.publish(number, [_store_run(scan(spark, store), store)])


def drop_unused(spark: SparkSession, store: str) -> int:
    """Delete the runs that the newest version does not name; returns how many."""
    versions = Versions(spark, store)
    _, runs = versions.current()
    unused = versions.siblings(store, "run-", runs)
    versions.delete(unused)
    return len(unused)
