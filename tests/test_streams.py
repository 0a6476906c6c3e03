"""Replay, restart and roll-ups on small topics."""

import pytest
from helpers import physical, row_set, rows
from pyspark.sql import functions as F

from millrace.operators.aggregates import word_count
from millrace.session import scratch_dir
from millrace.sinks.topic import write_topic
from millrace.sources.files import MissingConnector
from millrace.sources.topic import read_offsets, read_topic
from millrace.streaming.aggregates import metric_rollup, stream_word_count
from millrace.streaming.runs import (
    drain,
    drain_totals,
    drain_updates,
    incremental_ingest,
    merge_updates,
    newest_totals,
    newest_values,
    replay,
    state_rows,
)


def publish(spark, topic, lines):
    write_topic(spark.createDataFrame([(line,) for line in lines], "v string"), topic, F.col("v"))


def test_a_later_consumer_sees_old_and_new_messages(spark):
    base = scratch_dir(spark, "messages")
    messages = [f"message{i}" for i in range(51)]
    publish(spark, f"{base}/topic", messages)
    assert replay(spark, f"{base}/topic", f"{base}/one", f"{base}/s1").count() == 51
    publish(spark, f"{base}/topic", messages)
    second = replay(spark, f"{base}/topic", f"{base}/two", f"{base}/s2")
    assert sorted(r.value for r in second.collect()) == sorted(messages * 2)


def test_a_restarted_consumer_reads_only_what_is_new(spark):
    base = scratch_dir(spark, "restart")
    publish(spark, f"{base}/topic", ["a", "b"])
    first = replay(spark, f"{base}/topic", f"{base}/out", f"{base}/state")
    assert replay(spark, f"{base}/topic", f"{base}/out", f"{base}/state").count() == 2
    publish(spark, f"{base}/topic", ["c"])
    third = replay(spark, f"{base}/topic", f"{base}/out", f"{base}/state")
    assert sorted(r.value for r in third.collect()) == ["a", "b", "c"]
    assert first.count() == 2


def test_an_empty_topic_gives_no_rows(spark):
    base = scratch_dir(spark, "quiet")
    publish(spark, f"{base}/topic", ["a"])
    quiet = read_topic(spark, f"{base}/topic").where("value = 'b'")
    assert drain(quiet, f"{base}/out", f"{base}/s1").count() == 0
    nothing = spark.readStream.schema("key STRING, value STRING").option("pathGlobFilter", "none").parquet(f"{base}/topic")
    assert drain(nothing, f"{base}/out2", f"{base}/s2").columns == ["key", "value"]
    assert drain_totals(stream_word_count(nothing), f"{base}/out3", f"{base}/s3").count() == 0


def test_ingest_in_bounded_batches(spark):
    base = scratch_dir(spark, "bounded")
    spark.range(0, 60, 1, 6).write.json(f"{base}/in")
    got = incremental_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state", "id LONG", max_files=2)
    assert sorted(r.id for r in got.collect()) == list(range(60))


def test_word_counts_go_on_after_a_restart(spark):
    base = scratch_dir(spark, "counts")
    texts = ["to be or not", "not to be"]
    for text in texts:
        publish(spark, f"{base}/topic", [text])
        counts = stream_word_count(read_topic(spark, f"{base}/topic"))
        totals = drain_totals(counts, f"{base}/counts", f"{base}/state")
    batch = word_count(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert row_set(totals) == row_set(batch)


def test_a_failed_batch_leaves_the_older_totals(spark):
    base = scratch_dir(spark, "failed")
    publish(spark, f"{base}/topic", ["a b"])
    totals = drain_totals(stream_word_count(read_topic(spark, f"{base}/topic")), f"{base}/counts", f"{base}/state")
    assert row_set(totals) == [("a", 1), ("b", 1)]
    publish(spark, f"{base}/topic", ["a"])
    broken = stream_word_count(read_topic(spark, f"{base}/topic")).withColumn("n", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        drain_totals(broken, f"{base}/counts", f"{base}/state")
    assert row_set(newest_totals(totals, f"{base}/counts")) == [("a", 1), ("b", 1)]


def test_offsets_grow_and_backlogs_are_read_in_pieces(spark):
    base = scratch_dir(spark, "offsets")
    for text in ("x", "y", "z"):
        publish(spark, f"{base}/topic", [f"{text}{i}" for i in range(20)])
    seen = replay(spark, f"{base}/topic", f"{base}/out", f"{base}/state", max_files=1)
    places = [(r.partition, r.offset) for r in seen.collect()]
    assert len(set(places)) == len(places) == 60
    first = {r.value[0]: r.offset for r in seen.orderBy(F.desc("offset")).collect()}
    assert first["x"] < first["y"] < first["z"]
    assert len(list(spark.sparkContext._jvm.java.io.File(f"{base}/state/commits").list())) >= 3


SAMPLES = [
    ("2024-01-01 00:00:00", "a100", "0", 10.0),
    ("2024-01-01 00:00:09.999", "a100", "0", 30.0),
    ("2024-01-01 00:00:10", "a100", "0", 50.0),
    ("2024-01-01 00:00:05", "a100", "1", 70.0),
    ("2024-01-01 00:00:05", "t4", "0", None),
]
ROLLED = [
    ("2024-01-01 00:00:00", "a100", "0", 2, 20.0, 30.0),
    ("2024-01-01 00:00:00", "a100", "1", 1, 70.0, 70.0),
    ("2024-01-01 00:00:00", "t4", "0", 0, None, None),
    ("2024-01-01 00:00:10", "a100", "0", 1, 50.0, 50.0),
]


def samples(spark):
    raw = spark.createDataFrame(SAMPLES, "ts string, gpu_type string, gpu_bus_id string, value double")
    return raw.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_rollup_of_stored_and_streamed_samples(spark):
    labels = ["gpu_type", "gpu_bus_id"]
    text = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    stored = metric_rollup(samples(spark), "10 seconds", labels)
    assert row_set(stored.withColumn("window_start", text)) == sorted(ROLLED, key=repr)
    base = scratch_dir(spark, "rollup")
    samples(spark).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(samples(spark).schema).parquet(f"{base}/in")
    rolled = drain_totals(metric_rollup(stream, "10 seconds", labels), f"{base}/out", f"{base}/state")
    assert row_set(rolled.withColumn("window_start", text)) == sorted(ROLLED, key=repr)


def test_rollup_with_bounded_lateness_emits_closed_windows(spark):
    base = scratch_dir(spark, "late")
    for index, ts in enumerate(["2024-01-01 00:00:01", "2024-01-01 00:05:00", "2024-01-01 00:00:02"]):
        batch = spark.createDataFrame([(ts, "x", 1.0)], "ts string, kind string, value double")
        batch.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(f"{base}/in")
        rolled = metric_rollup(stream, "10 seconds", ["kind"], lateness="1 minute")
        drain(rolled, f"{base}/out", f"{base}/state")
    closed = spark.read.parquet(f"{base}/out")
    assert [r[2] for r in rows(closed)] == [1]


def test_broker_topics_need_their_connector(spark):
    with pytest.raises(MissingConnector):
        read_topic(spark, "t", brokers="localhost:1")
    with pytest.raises(MissingConnector):
        write_topic(spark.range(1), "t", F.col("id"), brokers="localhost:1")


def written(spark, out, batch):
    return row_set(spark.read.parquet(f"{out}/batch={batch}"))


def test_update_batches_hold_changed_words_only(spark):
    base = scratch_dir(spark, "updates")
    out, state = f"{base}/counts", f"{base}/state"
    counts = None
    for number, lines in enumerate((["a b", "b c"], ["c"], ["d d", "a"])):
        publish(spark, f"{base}/topic", lines)
        counts = stream_word_count(read_topic(spark, f"{base}/topic"))
        progress = drain_updates(counts, out, state, ["word"])
        assert progress.late_rows == 0 and progress.state_rows == [3, 3, 4][number]
    assert written(spark, out, 1) == [("c", 2)] and written(spark, out, 2) == [("a", 2), ("d", 2)]
    want = [("a", 2), ("b", 2), ("c", 2), ("d", 2)]
    assert row_set(newest_values(counts, out, ["word"])) == want
    # The state of the stopped query is the same, and a restart without news changes nothing.
    assert row_set(state_rows(spark, state)) == want
    drain_updates(counts, out, state, ["word"])
    assert merge_updates(counts, out, ["word"]) == 1 and merge_updates(counts, out, ["word"]) == 1
    assert row_set(newest_values(counts, out, ["word"])) == want
    publish(spark, f"{base}/topic", ["b"])
    drain_updates(counts, out, state, ["word"])
    assert merge_updates(counts, out, ["word"]) == 2
    assert row_set(newest_values(counts, out, ["word"])) == [("a", 2), ("b", 3), ("c", 2), ("d", 2)]


def test_a_repeated_batch_replaces_itself(spark):
    base = scratch_dir(spark, "again")
    publish(spark, f"{base}/topic", ["a a", "b"])
    counts = stream_word_count(read_topic(spark, f"{base}/topic"))
    drain_updates(counts, f"{base}/counts", f"{base}/state", ["word"])
    first = row_set(newest_values(counts, f"{base}/counts", ["word"]))
    drain_updates(counts, f"{base}/counts", f"{base}/state2", ["word"])
    assert row_set(newest_values(counts, f"{base}/counts", ["word"])) == first == [("a", 2), ("b", 1)]


def test_rollup_updates_close_windows_and_count_late_rows(spark):
    base = scratch_dir(spark, "closing")
    keys, schema = ["window_start", "gpu_type"], "ts timestamp_ntz, gpu_type string, value double"
    days = [
        [("2024-01-01 00:00:01", 1.0), ("2024-01-01 00:00:02", 3.0), ("2024-01-01 00:00:11", 5.0)],
        [("2024-01-03 00:00:00", 7.0), ("2024-01-01 00:00:03", 9.0)],
        [("2024-01-01 00:00:04", 100.0), ("2024-01-03 00:00:01", 9.0)],
    ]
    late, state, rolled = [], [], None
    for day in days:
        rows_of = spark.createDataFrame([(t, "a100", v) for t, v in day], "ts string, gpu_type string, value double")
        rows_of.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        stream = spark.readStream.schema(schema).parquet(f"{base}/landing")
        rolled = metric_rollup(stream, "10 seconds", ["gpu_type"], lateness="1 day")
        progress = drain_updates(rolled, f"{base}/out", f"{base}/state", keys)
        late.append(progress.late_rows)
        state.append(progress.state_rows)
    got = newest_values(rolled, f"{base}/out", keys).withColumn("window_start", F.col("window_start").cast("string"))
    assert row_set(got) == [
        ("2024-01-01 00:00:00", "a100", 3, pytest.approx(13 / 3), 9.0),
        ("2024-01-01 00:00:10", "a100", 1, 5.0, 5.0),
        ("2024-01-03 00:00:00", "a100", 2, 8.0, 9.0),
    ]
    assert sum(late) == 1 and state[-1] == 1


def test_records_are_read_by_offset(spark):
    base = scratch_dir(spark, "seek")
    for text in ("x", "y"):
        publish(spark, f"{base}/topic", [f"{text}{i}" for i in range(20)])
    whole = read_offsets(spark, f"{base}/topic", 0).collect()
    offsets = [r.offset for r in whole]
    assert offsets == sorted(set(offsets)) and {r.value[0] for r in whole} == {"x", "y"}
    middle = offsets[len(offsets) // 2]
    assert [r.offset for r in read_offsets(spark, f"{base}/topic", 0, middle, offsets[-1]).collect()] == offsets[len(offsets) // 2 : -1]
    plan = physical(read_offsets(spark, f"{base}/topic", 0, middle))
    assert "GreaterThanOrEqual(offset," in plan and "IsNotNull(offset)" in plan
