"""Model training and gang-scheduled queries over the labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.text import terms
from millrace.ml.boosted import area_under_roc, evaluate_binary
from millrace.ml.indexing import index_round_trip
from millrace.ml.network import fit_mlp, predict_mlp
from millrace.ml.ranks import run_ranks
from millrace.ml.search import Search, auto_train
from millrace.ml.trees import fit_trees
from millrace.operators.projection import split_features
from millrace.session import cut_lineage
from millrace.sources.catalog import table

FEATURES = ["n_chars", "n_terms", "n_lines", "n_digits", "n_marks", "different", "mark_share"]


# Fixed value: one document in so many, by the digest of its id, is kept for evaluation.
EVALUATED = 5
# Floors of the area under the ROC curve on the documents kept for evaluation.
TREES_FLOOR, NETWORK_FLOOR = 0.9, 0.9


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every labelled document with shape features of its whole text and the column ``1`` as label.

    The texts are read once; what is returned is a stored narrow table.
    """
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("1"))
    text = F.col("text")
    documents = table(spark, folder, "documents").join(labels, "doc_id").withColumn("terms", terms(text))
    marks = F.length(F.regexp_replace(text, "[^#*$%&|<>]", "")).cast("double")
    documents = documents.select(
        "doc_id",
        "lang",
        "1",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size("terms").cast("double").alias("n_terms"),
        F.length(F.regexp_replace(text, "[^\n]", "")).cast("double").alias("n_lines"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double").alias("n_digits"),
        F.length(F.regexp_replace(text, "[^!-/|]", "")).cast("double").alias("n_marks"),
        (F.size(F.array_distinct("terms")) / F.greatest(F.size("terms"), F.lit(1))).alias("different"),
        (marks / F.greatest(F.length(text), F.lit(1))).alias("mark_share"),
    )
    return cut_lineage(documents)


def train_and_eval(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to learn from and the rows kept for evaluation, by a digest of the id."""
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    kept = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % EVALUATED == 0
    return rows.where(~kept), rows.where(kept)


def _scored_counts(scored: DataFrame, auc: float, floor: float) -> DataFrame:
    """Scored rows per label and whether the model ranks them at least as well as the floor."""
    return scored.groupBy(F.col("`1`").alias("label")).agg(
        F.count("prediction").alias("scored"), F.lit(floor <= auc <= 1.0).alias("above_floor")
    )


def gbt_auc(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred rounds of boosted trees, measured on documents they have not seen."""
    training, held = train_and_eval(labelled_documents(spark, folder))
    model = fit_trees(training, FEATURES, "1", rounds=100, depth=8)
    return _scored_counts(*evaluate_binary(model, held, "1"), TREES_FLOOR)


def score_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the ROC curve of a plain score, the document length."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("1"))
    rows = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")).join(labels, "doc_id")
    auc = area_under_roc(rows, "1", "n_chars")
    return rows.agg(F.count("1").alias("scored"), F.round(F.lit(auc), 6).alias("auc"))


def _checked_board(found: Search, metric: str, within: Column) -> DataFrame:
    """Trials of a search, whether their scores are possible and whether ranks follow scores."""
    better = F.col(f"b.{metric}") < F.col(f"a.{metric}") if metric == "rmse" else F.col(f"b.{metric}") > F.col(f"a.{metric}")
    a, b = found.leaderboard.alias("a"), found.leaderboard.alias("b")
    wrong = a.join(b, (F.col("b.rank") == F.col("a.rank") + 1) & better).select("a.rank")
    ordered = wrong.isEmpty()
    return found.leaderboard.select("model", "settings", within.alias("possible"), F.lit(ordered).alias("ordered"))


def automl_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Trials on the documents to learn from, with the leader measured on the others."""
    training, held = train_and_eval(labelled_documents(spark, folder))
    learn, _ = split_features(training, "1", ["doc_id"])
    found = auto_train(learn, "1")
    auc = area_under_roc(found.predict(held.drop("doc_id"), "1"), "1")
    board = _checked_board(found, "auc", F.col("auc").between(0, 1))
    return board.withColumn("leader_above_floor", F.lit(auc >= TREES_FLOOR))


def automl_regression(spark: SparkSession, folder: str) -> DataFrame:
    """The number of terms regressed on the other features; the leader beats the mean on unseen documents."""
    training, held = train_and_eval(labelled_documents(spark, folder))
    learn, _ = split_features(training, "n_terms", ["doc_id", "1"])
    found = auto_train(learn, "n_terms", budget=3)
    scored = found.predict(held.drop("doc_id", "1"), "n_terms")
    mean = training.agg(F.avg("n_terms")).first()[0]
    errors = scored.agg(
        F.sum((F.col("prediction") - F.col("n_terms")) ** 2).alias("own"), F.sum((F.lit(mean) - F.col("n_terms")) ** 2).alias("flat")
    ).first()
    board = _checked_board(found, "rmse", F.col("rmse") >= 0)
    return board.withColumn("leader_beats_mean", F.lit(errors["own"] < 0.5 * errors["flat"]))


def category_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """Source of every document to an index and back."""
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return index_round_trip(documents, "source").select("doc_id", F.col("source_restored").alias("source"))


def category_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The same on a column with a value per customer, with the index of each."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    indexed = index_round_trip(customers, "c_name")
    return indexed.select("c_custkey", F.col("index").cast("bigint").alias("index"), "c_name_restored")


def mlp_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Features through a hidden layer; probabilities of documents the network has not seen."""
    training, held = train_and_eval(labelled_documents(spark, folder))
    model = fit_mlp(training, FEATURES, "1", epochs=30)
    scored = cut_lineage(predict_mlp(model, held))
    auc = area_under_roc(scored, "1", "predict")
    return scored.groupBy(F.col("`1`").alias("label")).agg(
        F.count("predict").alias("scored"),
        (F.min(F.col("predict").between(0, 1)) & F.lit(auc >= NETWORK_FLOOR)).alias("above_floor"),
    )


def _sum_rows(
    rank: int, size: int, context: BarrierTaskContext, batches: Iterator[pd.DataFrame], magic: int
) -> pd.DataFrame:
    """Count and add up this rank's rows and tell all the others."""
    rows = total = 0
    for batch in batches:
        rows, total = rows + len(batch), total + int(batch["user_id"].sum())
    everyone = [[int(part) for part in said.split()] for said in context.allGather(f"{rows} {total}")]
    seen, seen_total = (sum(column) for column in zip(*everyone))
    return pd.DataFrame(
        {"rank": [rank], "size": [size], "own": [rows], "seen": [seen], "seen_total": [seen_total], "magic": [magic]}
    )


def rank_map(spark: SparkSession, folder: str) -> DataFrame:
    """A function on as many ranks as there are slots; every rank knows the totals of all."""
    events = table(spark, folder, "events").select("user_id")
    schema = "rank INT, size INT, own BIGINT, seen BIGINT, seen_total BIGINT, magic INT"
    ranks = run_ranks(events, _sum_rows, None, schema, 42)
    return ranks.agg(
        F.sum("own").alias("rows"),
        F.max("seen").alias("seen"),
        F.max("seen_total").alias("user_ids"),
        F.max("magic").alias("magic"),
        ((F.min("seen") == F.max("seen")) & (F.count(F.lit(1)) == F.max("size"))).alias("agreed"),
    )


QUERIES = {
    "gbt_auc": gbt_auc,
    "score_auc": score_auc,
    "automl_leaderboard": automl_leaderboard,
    "automl_regression": automl_regression,
    "index_round_trip": category_indexes,
    "index_dictionary": category_dictionary,
    "mlp_predict": mlp_predict,
    "rank_map": rank_map,
}

def _held_out(flag: str) -> str:
    """Labels and number of the documents kept for evaluation."""
    return f"""
        SELECT quality AS label, count(*) AS scored, true AS {flag}
        FROM labels JOIN documents USING (doc_id)
        WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {EVALUATED} = 0 GROUP BY quality"""


ORACLES = {
    "gbt_auc": _held_out("above_floor"),
    "score_auc": """
        WITH d AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)),
        r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE
                     AS place FROM d),
        s AS (SELECT count(*) AS scored, sum(quality)::DOUBLE AS pos,
                     sum(CASE WHEN quality = 1 THEN place END) AS places FROM r)
        SELECT scored, round((places - pos * (pos + 1) / 2) / (pos * (scored - pos)), 6) AS auc FROM s""",
    "index_round_trip": "SELECT doc_id, source FROM documents",
    "index_dictionary": """
        SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS index, c_name AS c_name_restored FROM customer""",
    "mlp_predict": _held_out("above_floor"),
    "automl_leaderboard": """
        SELECT *, true AS possible, true AS ordered, true AS leader_above_floor
        FROM (VALUES ('logistic_regression', 'regParam=0.0'), ('logistic_regression', 'regParam=0.1'),
                     ('random_forest', 'maxDepth=4'), ('random_forest', 'maxDepth=8'),
                     ('boosted_trees', 'maxIter=10'), ('boosted_trees', 'maxIter=20')) AS t(model, settings)""",
    "automl_regression": """
        SELECT *, true AS possible, true AS ordered, true AS leader_beats_mean
        FROM (VALUES ('linear_regression', 'regParam=0.0'), ('random_forest', 'maxDepth=4'),
                     ('boosted_trees', 'maxIter=10')) AS t(model, settings)""",
    "rank_map": """
        SELECT count(*) AS rows, count(*) AS seen, CAST(sum(user_id) AS BIGINT) AS user_ids, 42 AS magic, true AS agreed
        FROM events""",
}
