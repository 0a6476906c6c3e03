"""Boosted-tree binary classification and its evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from millrace.session import cut_lineage, ensure_checkpoint_dir

FEATURES = "_features"


def assembled(df: DataFrame, features: list[str], label: str) -> tuple[VectorAssembler, DataFrame]:
    """The feature assembler and its output, stored: training passes read only this narrow table."""
    assembler = VectorAssembler(inputCols=features, outputCol=FEATURES)
    return assembler, cut_lineage(assembler.transform(df.select(*features, label)).select(FEATURES, label))


def fit_boosted(
    df: DataFrame, features: list[str], label: str, rounds: int = 100, depth: int = 5, seed: int = 42
) -> PipelineModel:
    """Logistic-loss boosted trees over the feature columns. ``label`` holds 0 and 1.

    Every round adds to the lineage of the residuals, so they are checkpointed to
    the shared folder every 25 rounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    assembler, training = assembled(df, features, label)
    trees = GBTClassifier(
        featuresCol=FEATURES, labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, checkpointInterval=25
    )
    return PipelineModel([assembler, trees.fit(training)])


def area_under_roc(scored: DataFrame, label: str, score: str = "rawPrediction") -> float:
    """Exact area under the ROC curve; ``score`` is a number or a raw-prediction vector."""
    pairs = scored.select(F.col(score).alias("score"), F.col(f"`{label}`").cast("double").alias("label"))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    return evaluator.evaluate(pairs)


def evaluate_binary(model: PipelineModel, df: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Score ``df`` and measure the area under the ROC curve."""
    scored = model.transform(df)
    return scored, area_under_roc(scored, label)
