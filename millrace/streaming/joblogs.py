"""Summaries of Spark event logs: JSON lines, plain or gzip, one application per file or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.session import cut_lineage

# The listener events and fields the summaries read.
LOG_SCHEMA = """
    Event STRING,
    `Job ID` BIGINT,
    `Submission Time` BIGINT,
    `Properties` STRUCT<`spark.job.description`: STRING>,
    `Stage ID` BIGINT,
    `Task Info` STRUCT<`Launch Time`: BIGINT, `Finish Time`: BIGINT, `Failed`: BOOLEAN>
"""
JOB_START = "SparkListenerJobStart"
TASK_END = "SparkListenerTaskEnd"
# Fixed value: how an application id looks inside a log path.
APPLICATION = r"((?:application|app|local)-?_?[0-9][0-9_-]*)"


def read_event_logs(spark: SparkSession, path: str, app_pattern: str = APPLICATION) -> DataFrame:
    """Raw log lines ``(app, value)`` of plain and gzip logs, the application taken from the file path."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(F.regexp_extract("_metadata.file_path", app_pattern, 1).alias("app"), "value")


def events_of(logs: DataFrame, kind: str) -> DataFrame:
    """Parsed lines of one listener event. Only lines that name it are parsed, broken ones drop out.

    ``inline`` keeps the filter on the parsed event from being moved into the
    parsing, which would then run twice per line.
    """
    named = logs.where(F.col("value").contains(kind))
    parsed = named.select("app", F.inline(F.array(F.from_json("value", LOG_SCHEMA))))
    return parsed.where(F.col("Event") == kind)


def jobs_per_day(logs: DataFrame) -> DataFrame:
    """Jobs started per day and description, ``(day, job_type, jobs)``."""
    return events_of(logs, JOB_START).groupBy(
        F.timestamp_millis("`Submission Time`").cast("date").alias("day"),
        F.col("Properties.`spark.job.description`").alias("job_type"),
    ).agg(F.count(F.lit(1)).alias("jobs"))


# Run times of one coarse bucket differ by less than this; it holds at most so many distinct ones.
BUCKET_MS = 1 << 16


def exact_medians(tasks: DataFrame) -> DataFrame:
    """``(app, stage, median_ms)``: the lower median of every stage's run times.

    Tasks are first counted per run time, then per coarse bucket. The bucket that holds the
    middle task is ranked run time by run time; no task list is ever sorted.
    """
    group = ["app", "stage"]
    counts = cut_lineage(
        tasks.where("ms IS NOT NULL")
        .groupBy(*group, F.floor(F.col("ms") / BUCKET_MS).alias("bucket"), "ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    buckets = counts.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*group))
    middle = F.ceil(F.col("total") / 2)
    placed = buckets.select(*group, "bucket", (upto - F.col("n")).alias("before"), upto.alias("upto"), total.alias("total"))
    held = placed.where((F.col("before") < middle) & (middle <= F.col("upto"))).select(
        *group, "bucket", (middle - F.col("before")).alias("place")
    )
    inside = counts.join(held, [*group, "bucket"])
    seen = F.sum("n").over(Window.partitionBy(*group).orderBy("ms"))
    reached = inside.select(*group, "ms", "place", seen.alias("seen")).where(F.col("seen") >= F.col("place"))
    return reached.groupBy(*group).agg(F.min("ms").alias("median_ms"))


def stage_statistics(logs: DataFrame) -> DataFrame:
    """Tasks per application and stage with total, longest and exact median run time in milliseconds."""
    info = F.col("Task Info")
    tasks = events_of(logs, TASK_END).select(
        "app", F.col("Stage ID").alias("stage"), (info["Finish Time"] - info["Launch Time"]).alias("ms")
    )
    tasks = cut_lineage(tasks)
    sums = tasks.groupBy("app", "stage").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms")
    )
    same = (F.col("s.app") == F.col("m.app")) & F.col("s.stage").eqNullSafe(F.col("m.stage"))
    return sums.alias("s").join(exact_medians(tasks).alias("m"), same, "left").select("s.*", "m.median_ms")


def summarize_event_logs(spark: SparkSession, path: str, app_pattern: str = APPLICATION) -> tuple[DataFrame, DataFrame]:
    """Both summaries of a log folder: jobs per day and type, and stage statistics."""
    logs = read_event_logs(spark, path, app_pattern)
    return jobs_per_day(logs), stage_statistics(logs)
