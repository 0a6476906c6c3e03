"""Bounded runs of streaming queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources.topic import read_topic


def stored(stream: DataFrame, out: str) -> DataFrame:
    """What runs have written so far; no rows before the first record arrived."""
    spark = stream.sparkSession
    try:
        return spark.read.schema(stream.schema).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything available, append it to Parquet exactly once, stop.

    The returned DataFrame holds what is committed by now; later runs do not change it.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stored(stream, out)


SNAPSHOTS_KEPT = 2


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def complete_snapshots(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose snapshots are written in full, oldest first."""
    pattern, files = _folder(spark, f"{out}/batch=*/_SUCCESS")
    return sorted(int(found.getPath().getParent().getName().removeprefix("batch=")) for found in files.globStatus(pattern) or [])


def newest_totals(stream: DataFrame, out: str) -> DataFrame:
    """The newest complete snapshot; no rows before the first one."""
    spark = stream.sparkSession
    batches = complete_snapshots(spark, out)
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={batches[-1]}")


def drain_totals(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything available into a running aggregate, kept as Parquet snapshots.

    Each micro-batch writes a snapshot of its own beside the older ones; readers take the newest
    complete one, so a failed batch leaves the result before it. State lives in the checkpoint, so a
    later run with the same one goes on counting.
    """

    def store(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        spark = result.sparkSession
        for old in complete_snapshots(spark, out)[:-SNAPSHOTS_KEPT]:
            folder, files = _folder(spark, f"{out}/batch={old}")
            files.delete(folder, True)

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return newest_totals(stream, out)


@dataclass
class Progress:
    """What one run of a stateful query did: its micro-batches, rows that came too late, rows of state at the end."""

    batches: int
    late_rows: int
    state_rows: int


def _merged_upto(spark: SparkSession, out: str) -> int:
    """The newest batch that a merged folder covers, or -1."""
    pattern, files = _folder(spark, f"{out}/merged=*/_SUCCESS")
    found = [int(f.getPath().getParent().getName().removeprefix("merged=")) for f in files.globStatus(pattern) or []]
    return max(found, default=-1)


def newest_values(stream: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """The newest row of every key that update batches have written; no rows before the first one."""
    spark = stream.sparkSession
    base = _merged_upto(spark, out)
    return _newest_of(stream, out, keys, [n for n in complete_snapshots(spark, out) if n > base], base)


def _newest_of(stream: DataFrame, out: str, keys: list[str], batches: list[int], base: int) -> DataFrame:
    spark = stream.sparkSession
    paths = [f"{out}/batch={number}" for number in batches] + ([f"{out}/merged={base}"] if base >= 0 else [])
    if not paths:
        return spark.createDataFrame([], stream.schema)
    # Every folder is named by the newest batch in it.
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:batch|merged)=([0-9]+)/[^/]*$", 1).cast("bigint")
    rows = spark.read.schema(stream.schema).parquet(*paths).select("*", number.alias("_batch"))
    newest = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *[c for c in stream.columns if c not in keys])).alias("_row"))
    return newest.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns])


def drain_updates(stream: DataFrame, out: str, checkpoint: str, keys: list[str]) -> Progress:
    """Process everything available into a running aggregate and store only what each micro-batch changes.

    A batch writes the changed rows into a folder of its own, which a repeated batch writes again, so
    every key has its newest value exactly once for readers (``newest_values``). With a watermark on the
    stream, closed windows leave the state, and rows that come later are counted and left out.
    """

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    told = query.recentProgress
    operators = [operator for one in told for operator in one["stateOperators"]]
    return Progress(
        len(told),
        sum(operator["numRowsDroppedByWatermark"] for operator in operators),
        operators[-1]["numRowsTotal"] if operators else 0,
    )


def merge_updates(stream: DataFrame, out: str, keys: list[str]) -> int:
    """Merge the batches written so far into one folder and drop them; returns the newest merged batch.

    The newest batch stays as well: a restarted query may write it again.
    """
    spark = stream.sparkSession
    batches = complete_snapshots(spark, out)
    before = _merged_upto(spark, out)
    upto = batches[-2] if len(batches) > 1 else -1
    if upto <= before:
        return before
    kept = [number for number in batches if number <= upto]
    _newest_of(stream, out, keys, kept, before).write.mode("overwrite").parquet(f"{out}/merged={upto}")
    for path in [f"{out}/batch={number}" for number in kept] + ([f"{out}/merged={before}"] if before >= 0 else []):
        folder, files = _folder(spark, path)
        files.delete(folder, True)
    return upto


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys and values that a stopped query keeps in its checkpoint, as columns."""
    return spark.read.format("statestore").load(checkpoint).select("key.*", "value.*")


def replay(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    brokers: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Copy a topic from its first record. A known checkpoint continues, a new one starts over.

    ``max_files`` bounds a micro-batch, so that a long backlog is committed piece by piece.
    """
    return drain(read_topic(spark, source, brokers, max_files), out, checkpoint)


def incremental_ingest(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    schema: str,
    fmt: str = "json",
    max_files: int | None = None,
) -> DataFrame:
    """Move files that arrived since the last run into a Parquet dataset."""
    stream = spark.readStream.schema(schema).format(fmt)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return drain(stream.load(source), out, checkpoint)
