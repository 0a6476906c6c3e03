"""Topics, incremental ingestion, running aggregates and job-log summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.aggregates import row_count
from millrace.session import scratch_dir
from millrace.sinks.topic import write_topic
from millrace.sources.catalog import table
from millrace.sources.topic import read_topic
from millrace.streaming.aggregates import metric_rollup, stream_word_count
from millrace.streaming.joblogs import jobs_per_day, read_event_logs, stage_statistics
from millrace.streaming.runs import drain_updates, incremental_ingest, merge_updates, newest_values, replay, state_rows

WINDOW_TEXT = "yyyy-MM-dd HH:mm:ss"


def _publish_events(spark: SparkSession, folder: str, topic: str) -> None:
    write_topic(table(spark, folder, "events"), topic, F.col("props"), F.col("event_id"))


def topic_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Publish every event, read from the beginning, publish again, read again as a new consumer."""
    base = scratch_dir(spark, "topic")
    reads = []
    for consumer in (1, 2):
        _publish_events(spark, folder, f"{base}/topic")
        seen = replay(spark, f"{base}/topic", f"{base}/out{consumer}", f"{base}/state{consumer}")
        reads.append(row_count(seen, "messages").select(F.lit(consumer).alias("consumer"), "messages"))
    return reads[0].unionByName(reads[1])


def topic_resume(spark: SparkSession, folder: str) -> DataFrame:
    """One consumer restarted on its checkpoint: everything, then nothing new, then only the new records."""
    base = scratch_dir(spark, "resume")
    steps = []
    for step in (1, 2, 3):
        if step != 2:
            _publish_events(spark, folder, f"{base}/topic")
        stored = replay(spark, f"{base}/topic", f"{base}/out", f"{base}/state")
        steps.append(row_count(stored, "stored").select(F.lit(step).alias("step"), "stored"))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def ingest_increments(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries of JSON files moved into one Parquet dataset, each row once."""
    base = scratch_dir(spark, "ingest")
    schema = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    purchases = F.col("event_type") == "purchase"
    for delivery in (events.where(purchases), events.where(~purchases)):
        delivery.write.mode("append").json(f"{base}/landing")
        stored = incremental_ingest(spark, f"{base}/landing", f"{base}/out", f"{base}/state", schema)
    return stored


def streamed_words(spark: SparkSession, folder: str) -> DataFrame:
    """Running word counts over messages published to a topic in three parts; each run stores what it changes."""
    base, counts = _count_words(spark, folder)
    return newest_values(counts, f"{base}/counts", ["word"])


def streamed_word_state(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts, read from the state of the stopped query."""
    base, _ = _count_words(spark, folder)
    return state_rows(spark, f"{base}/state").toDF("word", "n")


def _count_words(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    base = scratch_dir(spark, "words")
    conversations = table(spark, folder, "conversations")
    counts = None
    user, assistant = F.col("role").eqNullSafe("user"), F.col("role").eqNullSafe("assistant")
    for part in (conversations.where(user), conversations.where(assistant), conversations.where(~user & ~assistant)):
        write_topic(part, f"{base}/topic", F.col("text"), F.col("conv_id"))
        counts = stream_word_count(read_topic(spark, f"{base}/topic"))
        drain_updates(counts, f"{base}/counts", f"{base}/state", ["word"])
        merge_updates(counts, f"{base}/counts", ["word"])
    return base, counts


def _rollup_columns(rolled: DataFrame) -> DataFrame:
    return rolled.select(
        F.date_format(F.col("window_start").cast("timestamp_ntz"), WINDOW_TEXT).alias("window_start"),
        "event_type",
        "samples",
        F.round("mean", 9).alias("mean"),
        "peak",
    )


def rollup_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _rollup_columns(metric_rollup(table(spark, folder, "events"), "10 seconds", ["event_type"]))


def rollup_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Ten-second roll-up of the events, delivered in three periods; windows older than a day are closed.

    Each run stores the windows it changes, and its state holds the windows of the last day only.
    """
    base = scratch_dir(spark, "rollup")
    events = table(spark, folder, "events").select("ts", "event_type", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * third / 3 for third in (1, 2)]
    before, after = F.col("ts") < F.lit(cuts[0]), F.col("ts") >= F.lit(cuts[1])
    rolled = None
    for period in (before | F.col("ts").isNull(), ~before & ~after, after):
        events.where(period).write.mode("append").parquet(f"{base}/landing")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/landing")
        rolled = metric_rollup(stream, "10 seconds", ["event_type"], lateness="1 day")
        drain_updates(rolled, f"{base}/rolled", f"{base}/state", ["window_start", "event_type"])
    return _rollup_columns(newest_values(rolled, f"{base}/rolled", ["window_start", "event_type"]))


def _write_logs(rows: DataFrame) -> str:
    """Rows in the event-log layout, one folder per application."""
    path = scratch_dir(rows.sparkSession, "logs")
    rows.write.partitionBy("app").option("compression", "gzip").json(path)
    return path


def event_log_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The events as job starts of one application."""
    started = table(spark, folder, "events").select(
        F.lit("A").alias("app"),
        F.lit("SparkListenerJobStart").alias("Event"),
        F.col("event_id").alias("Job ID"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("Submission Time"),
        F.struct(F.col("event_type").alias("spark.job.description")).alias("Properties"),
    )
    jobs = jobs_per_day(read_event_logs(spark, _write_logs(started), "app=([A-Z]+)"))
    return jobs.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "job_type", "jobs")


def event_log_stages(spark: SparkSession, folder: str) -> DataFrame:
    """The line items as finished tasks, with run times from their prices."""
    launched = F.col("l_orderkey")
    finished = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("app"),
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.col("l_linenumber").cast("bigint").alias("Stage ID"),
        F.struct(
            launched.alias("Launch Time"), (launched + F.floor(F.col("l_extendedprice")).cast("bigint")).alias("Finish Time")
        ).alias("Task Info"),
    )
    return stage_statistics(read_event_logs(spark, _write_logs(finished), "app=([A-Z]+)"))


QUERIES = {
    "topic_replay": topic_replay,
    "topic_resume": topic_resume,
    "incremental_ingest": ingest_increments,
    "stream_word_count": streamed_words,
    "stream_word_state": streamed_word_state,
    "metric_rollup": rollup_batch,
    "metric_rollup_stream": rollup_stream,
    "event_log_jobs": event_log_jobs,
    "event_log_stages": event_log_stages,
}


def _rollup_sql(interval: str) -> str:
    return f"""
        SELECT strftime(time_bucket(INTERVAL {interval}, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
               count(value) AS samples, round(avg(value), 9) AS mean, max(value) AS peak
        FROM events GROUP BY 1, 2"""


_WORDS = r"""
        SELECT word, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM conversations) GROUP BY word"""

ORACLES = {
    "topic_replay": """
        SELECT 1 AS consumer, count(*) AS messages FROM events UNION ALL SELECT 2, 2 * count(*) FROM events""",
    "topic_resume": """
        SELECT 1 AS step, count(*) AS stored FROM events
        UNION ALL SELECT 2, count(*) FROM events UNION ALL SELECT 3, 2 * count(*) FROM events""",
    "incremental_ingest": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_word_count": _WORDS,
    "stream_word_state": _WORDS,
    "metric_rollup": _rollup_sql("10 SECOND"),
    "metric_rollup_stream": _rollup_sql("10 SECOND"),
    "event_log_jobs": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS job_type, count(*) AS jobs FROM events GROUP BY 1, 2""",
    "event_log_stages": """
        SELECT l_returnflag AS app, CAST(l_linenumber AS BIGINT) AS stage, count(*) AS tasks,
               CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_ms,
               max(CAST(floor(l_extendedprice) AS BIGINT)) AS max_ms,
               quantile_disc(CAST(floor(l_extendedprice) AS BIGINT), 0.5) AS median_ms
        FROM lineitem GROUP BY 1, 2""",
}
