"""Gang-scheduled functions: every rank runs at the same time and can talk to the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

RankFunction = Callable[..., pd.DataFrame]


def run_ranks(
    df: DataFrame, fn: RankFunction, n: int | None, schema: StructType | str, *args: object
) -> DataFrame:
    """Run ``fn(rank, size, context, batches, *args)`` once on each of ``n`` ranks.

    Without ``n`` there are as many ranks as the cluster has slots.

    Rows are dealt evenly over the ranks and reach ``fn`` as an iterator of bounded
    batches. Spark starts the stage only when ``n`` slots are free and restarts all
    ranks if one is lost.
    """

    def on_rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        yield fn(context.partitionId(), len(context.getTaskInfos()), context, batches, *args)

    ranks = n or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(ranks).mapInPandas(on_rank, schema, barrier=True)
