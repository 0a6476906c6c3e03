"""Models on small tables, and gang-scheduled functions."""

import pickle

import numpy as np
import pandas as pd
import pytest
from helpers import row_set, rows
from pyspark import RDD
from pyspark.sql import functions as F

from millrace.ml import trees
from millrace.ml.boosted import area_under_roc, evaluate_binary, fit_boosted
from millrace.ml.indexing import index_round_trip, label_dictionary
from millrace.ml.network import fit_mlp, predict_mlp
from millrace.ml.ranks import run_ranks
from millrace.ml.search import auto_train


def two_features(spark):
    points = [(4.5, 7.25, 0), (0.75, 3.5, 1)]
    return spark.createDataFrame(points, "c0 double, c1 double, `1` int")


def test_boosted_trees_on_a_label_named_1(spark):
    df = two_features(spark)
    scored, auc = evaluate_binary(fit_boosted(df, ["c0", "c1"], "1", rounds=5, depth=2), df, "1")
    assert auc == 1.0
    assert {(r["1"], r.prediction) for r in scored.collect()} == {(0, 0.0), (1, 1.0)}


def test_area_under_roc_counts_ties_as_half(spark):
    data = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.2, 1), (0.9, 0)]
    pairs = [(p, n) for p, pl in data if pl for n, nl in data if not nl]
    expected = sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs)
    df = spark.createDataFrame(data, "s double, y int")
    assert area_under_roc(df, "y", "s") == pytest.approx(expected)


def test_network_separates_two_clusters(spark):
    points = [(float(i % 7), float(i % 5) + (20 if i % 2 else 0), i % 2) for i in range(60)]
    df = spark.createDataFrame(points, "a double, b double, y int")
    predicted = predict_mlp(fit_mlp(df, ["a", "b"], "y"), df)
    assert predicted.columns == ["a", "b", "y", "predict"]
    assert all((r.predict > 0.5) == (r.y == 1) for r in predicted.collect())


def test_leaderboard_is_ranked_and_repeatable(spark):
    points = [(i, float(i % 11), "abc"[i % 3], int(i % 11 > 5)) for i in range(80)]
    df = spark.createDataFrame(points, "id int, x double, kind string, CAPSULE int").drop("id")
    found = auto_train(df, "CAPSULE", budget=2, folds=2)
    board = found.leaderboard
    assert board.columns == ["rank", "model", "settings", "auc"]
    first = rows(board)
    assert [r[0] for r in first] == [1, 2] and first[0][3] >= first[1][3] > 0.9
    assert rows(auto_train(df.repartition(3), "CAPSULE", budget=2, folds=2).leaderboard) == first
    assert area_under_roc(found.predict(df, "CAPSULE"), "CAPSULE") > 0.9


def test_search_takes_many_levels_and_missing_values(spark):
    points = [
        (None if i % 9 == 0 else float(i % 11), None if i % 13 == 0 else f"k{i % 40}", f"u{i}", int(i % 11 > 5))
        for i in range(120)
    ]
    df = spark.createDataFrame(points, "x double, kind string, name string, y int")
    found = auto_train(df, "y", budget=2, folds=2)
    assert found.leaderboard.count() == 2
    unseen = spark.createDataFrame([(None, "new", None, 1)], df.schema)
    assert found.predict(unseen, "y").count() == 1
    assert found.preparation(df).count() == 120
    assert found.preparation.ranks["name"].count() == 120


def test_other_labels_are_regressed(spark):
    points = [(float(i), "ab"[i % 2], 3.0 * i + (40 if i % 2 else 0)) for i in range(90)]
    df = spark.createDataFrame(points, "x double, kind string, y double")
    found = auto_train(df, "y", budget=3, folds=2)
    assert found.leaderboard.columns == ["rank", "model", "settings", "rmse"]
    board = rows(found.leaderboard)
    assert board[0][1] == "linear_regression" and board[0][3] < 1 and [r[0] for r in board] == [1, 2, 3]
    assert all(abs(r.prediction - r.y) < 2 for r in found.predict(df, "y").collect())


LABELS = [(i, label) for i, label in enumerate(["a"] * 5 + ["b"] * 7 + ["c"] * 5 + ["d"] + [None] * 9)]


def test_index_round_trip_by_falling_frequency(spark):
    df = spark.createDataFrame(LABELS, "id int, label string")
    got = index_round_trip(df, "label")
    assert sorted(rows(got.select("id", "label_restored"))) == LABELS
    assert set(rows(got.select("label", "index").distinct())) == {
        ("b", 0.0), ("a", 1.0), ("c", 2.0), ("d", 3.0), (None, None),
    }


def test_dictionary_numbers_are_dense_over_many_partitions(spark):
    df = spark.range(0, 3000, 1, 7).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("label"))
    got = dict(rows(label_dictionary(df, "label")))
    assert got == {f"v{i:05d}": i for i in range(3000)}


def test_ranks_run_together_and_share_values(spark):
    def work(rank, size, context, batches, magic):
        total = sum(int(batch["id"].sum()) for batch in batches)
        shared = sum(int(x) for x in context.allGather(str(total)))
        return pd.DataFrame({"rank": [rank], "size": [size], "total": [shared], "magic": [magic]})

    got = run_ranks(spark.range(1000), work, 2, "rank INT, size INT, total LONG, magic INT", 42)
    assert row_set(got) == [(0, 2, 499500, 42), (1, 2, 499500, 42)]


def test_ranks_follow_the_slots(spark):
    def size(rank, size, context, batches):
        return pd.DataFrame({"rows": [sum(len(b) for b in batches)], "size": [size]})

    got = run_ranks(spark.range(1000), size, None, "rows LONG, size INT").collect()
    assert len(got) == got[0]["size"] == spark.sparkContext.defaultParallelism and sum(r["rows"] for r in got) == 1000


def noisy_rings(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] ** 2 + x[:, 1] ** 2 > 1.5) ^ (rng.random(n) < 0.05)).astype(int)
    return [(*map(float, row), int(label)) for row, label in zip(x, y)]


def test_trees_on_a_label_named_1(spark):
    df = two_features(spark)
    scored, auc = evaluate_binary(trees.fit_trees(df, ["c0", "c1"], "1", rounds=5, depth=2, least=0.01), df, "1")
    assert auc == 1.0
    assert {(r["1"], r.prediction) for r in scored.collect()} == {(0, 0.0), (1, 1.0)}


def test_trees_rank_unseen_rows_as_well_as_the_library(spark):
    df = spark.createDataFrame(noisy_rings(3000, 1), "a double, b double, c double, y int")
    held = spark.createDataFrame(noisy_rings(2000, 2), "a double, b double, c double, y int")
    ours = evaluate_binary(trees.fit_trees(df, ["a", "b", "c"], "y", rounds=30, depth=4), held, "y")[1]
    library = evaluate_binary(fit_boosted(df, ["a", "b", "c"], "y", rounds=30, depth=4), held, "y")[1]
    assert ours > 0.9 and ours >= library - 0.005


def test_jobs_over_many_blocks_grow_the_trees_of_one_task(spark, monkeypatch):
    df = spark.createDataFrame(noisy_rings(900, 3), "a double, b double, c double, y int").repartition(3)
    one = trees.fit_trees(df, ["a", "b", "c"], "y", rounds=4, depth=3)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 200)
    many = trees.fit_trees(df, ["a", "b", "c"], "y", rounds=4, depth=3)
    assert len(one.trees) == len(many.trees) == 4 and one.base == many.base
    for a, b in zip(one.trees, many.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.left == b.left).all()
        assert np.abs(a.value - b.value).max() < 1e-9


def test_the_driver_gets_splits_not_tables(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 31), float(i % 7), int(i % 31 > 11)) for i in range(2000)], "a double, b double, y int")
    got, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(trees, "BLOCK_ROWS", 100)
    trees.fit_trees(df, ["a", "b"], "y", rounds=3, depth=4)
    # A job gives a few numbers for each of at most 8 nodes, not sums of 2 x 65 bins from each task.
    assert len(got) >= 3 and max(len(pickle.dumps(found)) for found in got) < 2000


def test_a_single_split_is_the_best_by_second_order_gain(spark):
    rows_ = [(float(x), int(x > 6 or x == 2)) for x in range(12)]
    model = trees.fit_trees(spark.createDataFrame(rows_, "x double, y int"), ["x"], "y", rounds=1, depth=1, rate=1.0, smooth=1.0, least=0.0)
    share = sum(y for _, y in rows_) / 12
    best = None
    for cut in range(11):
        sides = [[share - y for x, y in rows_ if (x <= cut) == left] for left in (True, False)]
        gain = sum(sum(g) ** 2 / (len(g) * share * (1 - share) + 1) for g in sides)
        values = [-sum(g) / (len(g) * share * (1 - share) + 1) for g in sides]
        best = max(best or (-1, 0, 0), (gain, cut, values), key=lambda b: b[0])
    got = model.margins(np.array([[float(x)] for x in range(12)])) - model.base
    assert got == pytest.approx([best[2][0] if x <= best[1] else best[2][1] for x in range(12)])


def test_trees_take_missing_values_and_empty_tables(spark):
    rows_ = [(None if i % 4 == 0 else float(i % 5), float(i), int(i % 4 == 0)) for i in range(200)] + [(1.0, 2.0, None)]
    df = spark.createDataFrame(rows_, "x double, rawer double, y int")
    model = trees.fit_trees(df, ["x"], "y", rounds=5, depth=2)
    scored = model.transform(df.where("y IS NOT NULL"))
    assert area_under_roc(scored, "y") == 1.0 and scored.columns[:3] == ["x", "rawer", "y"]
    empty = trees.fit_trees(df.limit(0), ["x"], "y")
    assert empty.trees == [] and {r.probability for r in empty.transform(df).collect()} == {0.5}
