"""Event-log summaries, on hand-written lines."""

import gzip
import json
import random
import tempfile

from helpers import row_set

from millrace.streaming.joblogs import exact_medians, stage_statistics, summarize_event_logs

DAY = 1_704_067_200_000  # 2024-01-01 in UTC milliseconds


def job(number, kind, at):
    return {
        "Event": "SparkListenerJobStart",
        "Job ID": number,
        "Submission Time": at,
        "Properties": {"spark.job.description": kind},
    }


def task(stage, start, end):
    return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Launch Time": start, "Finish Time": end}}


def test_summaries_of_written_logs(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    first = [{"Event": "SparkListenerLogStart"}, job(0, "pi", DAY), job(1, "pi", DAY + 1), task(0, 5, 15), task(0, 5, 25)]
    second = [job(0, "sort", DAY + 86_400_000), task(0, 0, 7), task(3, 0, 9), task(3, 0, 5), task(3, 0, 1)]
    with open(f"{folder}/application_17_0001", "w") as log:
        log.write("".join(json.dumps(line) + "\n" for line in first) + "{cut off")
    with gzip.open(f"{folder}/application_17_0002.gz", "wt") as log:
        log.write("".join(json.dumps(line) + "\n" for line in second))
    jobs, stages = summarize_event_logs(spark, folder)
    assert [(str(d), t, n) for d, t, n in row_set(jobs)] == [("2024-01-01", "pi", 2), ("2024-01-02", "sort", 1)]
    assert row_set(stages) == [
        ("application_17_0001", 0, 2, 30, 20, 10),
        ("application_17_0002", 0, 1, 7, 7, 7),
        ("application_17_0002", 3, 3, 15, 9, 5),
    ]


def test_medians_are_exact_for_many_run_times(spark):
    pick = random.Random(3)
    times = {(app, stage): [pick.randrange(10 ** pick.randrange(1, 9)) for _ in range(n)]
             for app, stage, n in (("a", 1, 4001), ("a", 2, 600), ("b", 1, 1), ("b", 2, 2))}
    data = [(app, stage, ms) for (app, stage), values in times.items() for ms in values] + [("a", 1, None)]
    tasks = spark.createDataFrame(data, "app string, stage long, ms long")
    expected = [(app, stage, sorted(v)[(len(v) - 1) // 2]) for (app, stage), v in times.items()]
    assert row_set(exact_medians(tasks)) == sorted(expected, key=repr)


def test_lines_that_only_mention_an_event_do_not_count(spark):
    lines = [
        task(1, 5, 6),
        {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Task Info": {"Launch Time": 5}},
        {"Event": "SparkListenerJobStart", "Properties": {"spark.job.description": "SparkListenerTaskEnd"}},
    ]
    logs = spark.createDataFrame([("a", json.dumps(line)) for line in lines], "app string, value string")
    assert row_set(stage_statistics(logs)) == [("a", 1, 2, 1, 1, 1)]
