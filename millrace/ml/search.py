"""Model search within a trial budget: classification or regression by the label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from millrace.ml.boosted import FEATURES
from millrace.ml.indexing import label_dictionary
from millrace.session import cut_lineage, ensure_checkpoint_dir

LABEL = "_label"
FOLD = "_fold"

# The families of each task with the settings tried: one of each family first, then the variations.
CLASSIFIERS = [
    ("logistic_regression", LogisticRegression, {"regParam": 0.0}),
    ("random_forest", RandomForestClassifier, {"maxDepth": 4}),
    ("boosted_trees", GBTClassifier, {"maxIter": 10}),
    ("logistic_regression", LogisticRegression, {"regParam": 0.1}),
    ("random_forest", RandomForestClassifier, {"maxDepth": 8}),
    ("boosted_trees", GBTClassifier, {"maxIter": 20}),
]
REGRESSORS = [
    ("linear_regression", LinearRegression, {"regParam": 0.0}),
    ("random_forest", RandomForestRegressor, {"maxDepth": 4}),
    ("boosted_trees", GBTRegressor, {"maxIter": 10}),
    ("linear_regression", LinearRegression, {"regParam": 0.1}),
    ("random_forest", RandomForestRegressor, {"maxDepth": 8}),
    ("boosted_trees", GBTRegressor, {"maxIter": 20}),
]


def _trials(regression: bool, seed: int) -> list[tuple[str, str, Estimator]]:
    columns = {"featuresCol": FEATURES, "labelCol": LABEL}
    return [
        (
            name,
            ", ".join(f"{k}={v}" for k, v in varied.items()),
            family(**columns, **varied, **({} if "linear" in name or "logistic" in name else {"seed": seed})),
        )
        for name, family, varied in (REGRESSORS if regression else CLASSIFIERS)
    ]


class Preparation:
    """Feature vectors of all columns but the label, the same for training and for new rows.

    Missing numbers become the column mean. Text becomes the rank of its value by falling
    frequency, whatever the number of values; the ranks stay a stored table that is joined.
    Missing and unseen texts have rank -1.
    """

    def __init__(self, df: DataFrame, label: str):
        self.texts = [f.name for f in df.schema.fields if f.name != label and isinstance(f.dataType, StringType)]
        self.numbers = [name for name in df.columns if name not in (label, *self.texts)]
        self.ranks = {name: cut_lineage(label_dictionary(df.select(name), name)) for name in self.texts}
        self.imputer = Imputer(inputCols=self.numbers, outputCols=self.numbers).fit(self._numbers(df)) if self.numbers else None
        self.assembler = VectorAssembler(inputCols=[*self.numbers, *self.texts], outputCol=FEATURES)

    def _numbers(self, df: DataFrame, *others: Column) -> DataFrame:
        return df.select(*[F.col(f"`{name}`").cast("double").alias(name) for name in self.numbers], *others)

    def __call__(self, df: DataFrame, *others: Column) -> DataFrame:
        """``FEATURES`` and the columns ``others`` of every row."""
        rows = self._numbers(df, *[F.col(f"`{name}`") for name in self.texts], *others)
        if self.imputer:
            rows = self.imputer.transform(rows)
        kept = [name for name in rows.columns if name not in (*self.numbers, *self.texts)]
        for name in self.texts:
            rank = self.ranks[name].select(F.col("label").alias(name), F.col("index").cast("double").alias("_rank"))
            rows = rows.join(rank, name, "left").withColumn(name, F.coalesce("_rank", F.lit(-1.0))).drop("_rank")
        return self.assembler.transform(rows).select(FEATURES, *kept)


@dataclass
class Search:
    """The leaderboard ``(rank, model, settings, <metric>)``, and the best model fitted on all rows."""

    leaderboard: DataFrame
    leader: Transformer
    preparation: Preparation
    metric: str

    def predict(self, df: DataFrame, *keep: str) -> DataFrame:
        """The leader's output for new rows, with the columns ``keep`` of each."""
        return self.leader.transform(self.preparation(df, *[F.col(f"`{name}`").alias(f"_keep_{name}") for name in keep])).select(
            *[F.col(f"_keep_{name}").alias(name) for name in keep], "prediction", *(["rawPrediction"] if self.metric == "auc" else [])
        )


def _is_regression(df: DataFrame, label: str) -> bool:
    """Whether the label has other values than 0 and 1."""
    other = ~F.col(f"`{label}`").cast("double").isin(0.0, 1.0)
    return not df.where(other).isEmpty()


def auto_train(
    df: DataFrame,
    label: str,
    regression: bool | None = None,
    budget: int = 6,
    folds: int = 3,
    seed: int = 42,
    parallelism: int = 6,
) -> Search:
    """Cross-validate at most ``budget`` trials and return them ranked, with the best model.

    A label of 0 and 1 is classified, ranked by area under the ROC curve; any other is regressed,
    ranked by root mean squared error. Folds come from a hash of the row, so the same data gives
    the same folds on any cluster; the budget counts trials rather than seconds for the same reason.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    known = cut_lineage(df.where(F.col(f"`{label}`").isNotNull()))
    if regression is None:
        regression = _is_regression(known, label)
    preparation = Preparation(known, label)
    fold = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in known.columns]), F.lit(folds))
    prepared = cut_lineage(
        preparation(known, F.col(f"`{label}`").cast("double").alias(LABEL), fold.cast("int").alias(FOLD))
    )
    trials = _trials(regression, seed)[:budget]
    model = Pipeline(stages=[])
    if regression:
        evaluator = RegressionEvaluator(labelCol=LABEL, metricName="rmse")
    else:
        evaluator = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol=LABEL, numBins=0)
    search = CrossValidator(
        estimator=model,
        estimatorParamMaps=[{model.stages: [learner]} for _, _, learner in trials],
        evaluator=evaluator,
        numFolds=folds,
        foldCol=FOLD,
        seed=seed,
        parallelism=parallelism,
    )
    found = search.fit(prepared)
    metric, sign = ("rmse", 1) if regression else ("auc", -1)
    board = [(name, text, float(score)) for (name, text, _), score in zip(trials, found.avgMetrics)]
    board.sort(key=lambda trial: (sign * trial[2], trial[0], trial[1]))
    ranked = [(place, *trial) for place, trial in enumerate(board, start=1)]
    leaderboard = spark.createDataFrame(ranked, f"rank INT, model STRING, settings STRING, {metric} DOUBLE")
    return Search(leaderboard, found.bestModel, preparation, metric)
