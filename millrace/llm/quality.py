"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Standardised statistics are mapped to cosines of random projections, which approximate a
Gaussian kernel. Every partition sums its part of the normal equations, so a fit reads its rows
once and moves one matrix per task. Labelled rows of one fold calibrate the scores: their
sums by rounded score are pooled until the rate never falls.

Cases: a null or empty text is scored by the statistics of an empty text. Without labels of both classes
every score is the smoothed rate of label 1. Result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm import learning, statistics
from millrace.llm.common import with_results

NAMES = ["quality_score"]

# Cosines, the kernel's width in standard deviations per dimension, the ridge, the seed.
FEATURES = 256
WIDTH = 1.5
RIDGE = 1.0
SEED = 20240229
# Steps of the raw score that calibration tells apart.
STEPS = 2000
# Standardised statistics are held within this many standard deviations.
CLIP = 5.0


class Fourier:
    """A fixed random map from statistics to features, with an intercept as the last feature."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        random = np.random.default_rng(SEED)
        size = len(mean)
        self.mean, self.spread = mean, spread
        self.directions = random.normal(size=(size, FEATURES)) / (WIDTH * np.sqrt(size))
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        cosines = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([cosines, np.ones((len(x), 1))])


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and spreads of the statistics, in one aggregation."""
    parts = [f(F.col(name)).alias(f"{kind}_{name}") for name in statistics.SHARES for kind, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = rows.agg(*parts).first()
    mean = np.array([row[f"m_{name}"] or 0.0 for name in statistics.SHARES])
    spread = np.array([row[f"s_{name}"] or 0.0 for name in statistics.SHARES])
    return mean, np.where(spread > 1e-9, spread, 1.0)


def _normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the features' products and of their products with the label.

    A partition gives one row per row of its matrix; rows of equal number are added up.
    """
    size = FEATURES + 1
    names = statistics.SHARES

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(batch[names].to_numpy(dtype=float))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ batch["label"].to_numpy(dtype=float)
        yield pd.DataFrame({"place": range(size), "sums": list(total)})

    cells = rows.select(*names, "label").mapInPandas(part, "place int, sums array<double>")
    added = (
        cells.select("place", F.posexplode("sums").alias("at", "value"))
        .groupBy("place", "at")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    total = np.zeros((size, size + 1))
    total[added["place"], added["at"]] = added["value"]
    return total[:, :size], total[:, size]


def pooled(scores: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic fit: mean score and rate of each pool, by ascending score."""
    pools: list[list[float]] = []
    for s, g, c in zip(scores, good, count, strict=True):
        pools.append([s * c, g, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """The feature map, ridge weights and calibration."""

    def __init__(self, fourier, weights, knots, rates, base):
        self.fourier, self.weights = fourier, weights
        self.knots, self.rates, self.base = knots, rates, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.base)
        raw = self.raw(x)
        calibrated = np.interp(raw, self.knots, self.rates)
        # A trace of the raw score keeps the order inside a pool.
        return np.clip(0.99 * calibrated + 0.01 * np.clip(raw, 0, 1), 0.0, 1.0)


def _raw_column(model: Model):
    @F.pandas_udf("double")
    def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(model.raw(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return raw(*[F.col(name) for name in statistics.SHARES])


def fit(rows: DataFrame, calibrating) -> Model:
    """A model from rows of statistics with ``label``; ``calibrating`` tells the rows that only calibrate."""
    learn, hold = rows.where(~calibrating), rows.where(calibrating)
    totals = rows.agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).first()
    good, n = totals["good"] or 0, totals["n"]
    base = (good + 0.5) / (n + 1.0)
    mean, spread = _moments(learn)
    fourier = Fourier(mean, spread)
    if good in (0, n):
        return Model(fourier, np.zeros(FEATURES + 1), np.array([]), np.array([]), base)
    gram, target = _normal_equations(learn, fourier)
    penalty = np.full(FEATURES + 1, RIDGE)
    penalty[-1] = 1e-6
    weights = np.linalg.solve(gram + np.diag(penalty), target)
    model = Model(fourier, weights, np.array([]), np.array([]), base)
    steps = (
        hold.select(F.round(_raw_column(model) * STEPS).alias("step"), "label")
        .groupBy("step")
        .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
        .toPandas()
        .sort_values("step")
    )
    if len(steps):
        model.knots, model.rates = pooled(
            steps["step"].to_numpy(dtype=float) / STEPS, steps["good"].to_numpy(dtype=float), steps["n"].to_numpy(dtype=float)
        )
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """All columns of ``rows``, which hold the statistics, and ``quality_score`` from 0 to 1."""

    @F.pandas_udf("quality_score double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            yield pd.DataFrame({"quality_score": model.score(x)})

    return with_results(rows, scored(*[F.col(name) for name in statistics.SHARES]), NAMES)
