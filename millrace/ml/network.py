"""A small dense network on a DataFrame."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from millrace.ml.boosted import FEATURES, assembled

SCALED = "_scaled"


def fit_mlp(
    df: DataFrame, features: list[str], label: str, hidden: int = 8, epochs: int = 10, seed: int = 42
) -> PipelineModel:
    """One hidden layer of ``hidden`` units and a two-class output over scaled features.

    ``epochs`` counts full passes of the optimiser over the data.
    """
    assembler, training = assembled(df, features, label)
    scaler = StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True).fit(training)
    network = MultilayerPerceptronClassifier(
        layers=[len(features), hidden, 2], featuresCol=SCALED, labelCol=label, maxIter=epochs, seed=seed
    )
    return PipelineModel([assembler, scaler, network.fit(scaler.transform(training))])


def predict_mlp(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``predict``, the probability of class 1."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array(F.col("probability"))[1].alias("predict"))
