"""The registered queries: each name has a Spark job and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import arrays, formats, learning, relational, streams, texts

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (relational, formats, texts, arrays, streams, learning)


def all_queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
