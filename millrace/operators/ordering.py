"""Sorting, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.aggregates import count_by


def top_groups(df: DataFrame, keys: list[str], n: int | None = None, name: str = "n") -> DataFrame:
    """Groups by size, largest first, ties by key descending; all of them or the first ``n``."""
    ranked = count_by(df, keys, name).orderBy(F.desc(name), *[F.desc(k) for k in keys])
    return ranked if n is None else ranked.limit(n)


def head(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """The first ``n`` rows in the given order: each task keeps ``n``, one merges them."""
    return df.orderBy(*order).limit(n)


def peek(df: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """One row: the first in ``order``, or any when there is none."""
    return (df.orderBy(*order) if order else df).limit(1)
