"""Labelled samples and small models for the learned operators.

Models are fitted on at most a documented number of labelled rows, picked by a hash of the id;
corpus-wide numbers never come from a sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# The most labelled rows that a small model is fitted on.
SAMPLE_ROWS = 30_000


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str, folds: int, held_out: int) -> DataFrame:
    """Rows of ``docs`` with ``label`` 0 or 1, without the held-out fold.

    Labels that are null or not 0 or 1 are left out; of repeated labels the largest counts.
    """
    truth = (
        labels.select(F.col(f"`{key}`").alias(key), F.col(f"`{label}`").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (fold(key, folds) != held_out))
        .groupBy(key)
        .agg(F.max("label").alias("label"))
    )
    return docs.join(truth, key)


def bounded(rows: DataFrame, key: str, at_most: int = SAMPLE_ROWS) -> DataFrame:
    """All rows if they are few, else those with the smallest hashes of their id, about ``at_most``.

    The share is found by one count; no row is sorted or moved.
    """
    n = rows.count()
    if n <= at_most:
        return rows
    low = -(2**63)
    return rows.where(F.xxhash64(F.col(f"`{key}`")) < F.lit(low + int(2**64 * at_most / n)))


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and spreads of the columns; a constant column has spread 1."""
    spread = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    return (x.mean(axis=0) if len(x) else np.zeros(x.shape[1])), np.where(spread > 1e-9, spread, 1.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, without penalty.

    Without rows of both classes the weights are zero and the intercept is the smoothed rate.
    """
    weights = np.zeros(x.shape[1] + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    weights[-1] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return weights
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + penalty * weights
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(curve, gradient)
        weights -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return weights


def fit_logistic_rows(rows: DataFrame, ridge: float = 1.0, steps: int = 30) -> tuple[float, float]:
    """``fit_logistic`` for one column ``x`` and the class ``y`` of all rows; a job adds up each step."""
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    slope, shift = 0.0, float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if not 0 < ones < n:
        return slope, shift
    for _ in range(steps):
        raw = F.col("x") * slope + shift
        chances = rows.select("x", "y", (1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0))))).alias("p"))
        parts = chances.select("x", (F.col("p") - F.col("y")).alias("d"), (F.col("p") * (1 - F.col("p")) + 1e-9).alias("c"))
        sums = parts.agg(*[F.sum(part) for part in (F.col("d") * F.col("x"), F.col("d"), F.col("c") * F.col("x") ** 2, F.col("c") * F.col("x"), F.col("c"))])
        down, flat, both, cross, own = sums.first()
        curve = np.array([[both + ridge, cross], [cross, own + 1e-6]])
        move = np.linalg.solve(curve, np.array([down + ridge * slope, flat + 1e-6 * shift]))
        slope, shift = (float(old - step) for old, step in zip((slope, shift), np.clip(move, -5, 5), strict=True))
        if np.abs(move).max() < 1e-6:
            break
    return slope, shift


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
