"""Exact top-k inner products by a uniform threshold, in three phases.

The components of all vectors are cut into ``lists`` consecutive parts. For each query a part gives one
list: its share of the inner product for every candidate. The score of a candidate is the sum of
its entries over the lists, and no list is sorted or moved as a whole:

1. every block of a list gives its first entries; those candidates are scored exactly, and the
   k-th best of them is a score that the result cannot fall below (the cutoff);
2. the cutoff goes to all blocks with the queries. A candidate that reaches it must have an entry
   of at least ``cutoff / lists`` in some list, so only such entries are collected;
3. entries that the collected candidates have in the other lists are looked up, the sums are exact,
   and the k best remain.

Queries and candidates meet as blocks of rows (matrices) of bounded size, dealt by a hash of the
row. Of candidates with the same codes only the k + 1 smallest ids can be in a result, so the rest
are no candidates (they still ask). Phase 1 may gather any candidates without harm to the result;
it only has to find good ones for a high cutoff.

Cases: vectors that are null or hold null or non-finite components take no part. Shorter vectors
count as filled up with zeros. Ties go to the smaller id, null ids last. Repeated ids are rows of
their own: each asks for itself, and the other ones are candidates. Fewer candidates than k: all of
them. An empty table, or no query: no rows. Columns other than the id and the vector do not matter.
Scores are longs: tables with components so large that a score could pass 2^62 are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import prepare_workers
from millrace.llm.vectors import blocks, bound_batches, flat, floored, n_blocks, usable
from millrace.session import cut_lineage

# Candidates and queries in one block.
BLOCK_ROWS, QUERY_ROWS = 1024, 512

# The first phase gathers about this many times k entries of each list.
GATHER = 4

# Candidates whose missing entries are looked up at once.
LOOKUP_ROWS = 1 << 16

RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def matrix(column: pa.Array, at: int, n: int) -> np.ndarray:
    return flat(column, at).reshape(n, -1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices; exact in floating point where that is sure."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if largest < 2**53:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    return left @ right.T


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """For each record, its small fields, the entries of its list, and which are no candidates."""
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        for at in range(batch.num_rows):
            asking, rows = flat(column["asking"], at), flat(column["rows"], at)
            shares = products(matrix(column["query_codes"], at, len(asking)), matrix(column["codes"], at, len(rows)))
            record = {"asking": asking, "rows": rows} | {
                name: column[name][at].as_py() for name in ("block", "query_block", "part")
            }
            if "cutoffs" in column:
                record["cutoffs"] = flat(column["cutoffs"], at)
            yield record, shares, asking[:, None] == rows[None, :]


def gather(reach: int):
    """Phase 1: the first ``reach`` entries of every block of a list, for every query."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record, shares, own in _shares(batches):
            n = min(reach, shares.shape[1])
            shares[own] = np.iinfo(np.int64).min
            best = np.argpartition(shares, shares.shape[1] - n, axis=1)[:, shares.shape[1] - n :]
            asking = np.repeat(record["asking"], n)
            best_rows, best_shares = record["rows"][best].ravel(), np.take_along_axis(shares, best, 1).ravel()
            others = asking != best_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(asking[others]),
                    pa.array(np.full(int(others.sum()), record["part"], dtype=np.int32)),
                    pa.array(best_rows[others]),
                    pa.array(best_shares[others]),
                ],
                ["asks", "part", "row", "share"],
            )

    return gathered


def collect_entries(lists: int):
    """Phase 2: all entries that reach the cutoff's share; a query without cutoff takes all."""

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record, shares, own in _shares(batches):
            enough = lists * shares >= record["cutoffs"][:, None]
            query_at, row_at = np.nonzero(enough & ~own)
            if not len(row_at):
                continue
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": record["block"],
                        "query_block": record["query_block"],
                        "part": record["part"],
                        "query_at": query_at.astype(np.int32),
                        "row_at": row_at.astype(np.int32),
                        "shares": shares[query_at, row_at],
                    }
                ],
                schema=ENTRIES,
            )

    return collected


ENTRIES = pa.schema(
    [
        ("block", pa.int64()),
        ("query_block", pa.int64()),
        ("part", pa.int32()),
        ("query_at", pa.list_(pa.int32())),
        ("row_at", pa.list_(pa.int32())),
        ("shares", pa.list_(pa.int64())),
    ]
)
ENTRIES_SQL = "block bigint, query_block bigint, part int, query_at array<int>, row_at array<int>, shares array<bigint>"


def resolve(k: int):
    """Phase 3: the sums of all collected candidates of a pair of blocks, and the k best of each query."""

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for at in range(batch.num_rows):
                asking, rows = flat(column["asking"], at), flat(column["rows"], at)
                entries = column["entries"][at].values
                lists = {name: entries.field(name) for name in ("query_at", "row_at", "shares")}
                found = {
                    part: flat(lists["query_at"], i).astype(np.int64) * len(rows) + flat(lists["row_at"], i)
                    for i, part in enumerate(entries.field("part").to_pylist())
                }
                pairs = np.unique(np.concatenate(list(found.values())))
                query_at, row_at = np.divmod(pairs, len(rows))
                scores = np.zeros(len(pairs), dtype=np.int64)
                theirs = {
                    part: (np.searchsorted(pairs, places), flat(lists["shares"], i))
                    for i, (part, places) in enumerate(found.items())
                }
                sides = zip(column["query_parts"][at].values, column["parts"][at].values, strict=True)
                for part, (query_codes, codes) in enumerate(sides):
                    missing = np.ones(len(pairs), dtype=bool)
                    if part in theirs:
                        place, shares = theirs[part]
                        scores[place] += shares
                        missing[place] = False
                    left = query_codes.values.to_numpy(zero_copy_only=False).reshape(len(asking), -1)
                    right = codes.values.to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                    missing = np.flatnonzero(missing)
                    for start in range(0, len(missing), LOOKUP_ROWS):
                        some = missing[start : start + LOOKUP_ROWS]
                        scores[some] += np.einsum("ij,ij->i", left[query_at[some]], right[row_at[some]])
                reaches = scores >= flat(column["cutoffs"], at)[query_at]
                query_at, row_at, scores = query_at[reaches], row_at[reaches], scores[reaches]
                ids = column["ids"][at].values
                known = np.array(ids.is_valid())
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((rows[row_at], number[row_at], ~known[row_at], -scores, query_at))
                first = np.searchsorted(query_at[order], query_at[order])
                order = order[np.arange(len(order)) - first < k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(asking[query_at[order]]),
                        column["query_ids"][at].values.take(pa.array(query_at[order])),
                        pa.array(rows[row_at[order]]),
                        ids.take(pa.array(row_at[order])),
                        pa.array(scores[order]),
                    ],
                    ["asks", "query_id", "row", "vec_id", "score"],
                )

    return resolved


def _first(rows: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group, with their place."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def top_inner_products(
    vectors: DataFrame,
    asks: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    scale: int = 64,
    lists: int = 2,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every row for which ``asks`` holds."""
    spark = vectors.sparkSession
    prepare_workers(spark)
    bound_batches(spark)
    codes = cut_lineage(
        vectors.where(usable(vector)).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{key}`").cast("bigint").alias("id"),
            floored(vector, scale).alias("codes"),
            F.coalesce(asks, F.lit(False)).alias("asking"),
        )
    )
    low, high = F.array_min("codes"), F.array_max("codes")
    n, asking, length, largest = codes.agg(
        F.count("*"),
        F.count_if("asking"),
        F.max(F.size("codes")),
        F.max(F.greatest(-low.cast("double"), high.cast("double"))),
    ).first()
    if not asking:
        return spark.createDataFrame([], RESULT)
    if (largest or 0.0) ** 2 * length >= 2**62:
        raise ValueError("the components are too large for scores that are longs")
    width = max(1, math.ceil(length / lists))
    dealt, query_dealt = n_blocks(n, BLOCK_ROWS), n_blocks(asking, QUERY_ROWS)
    same = _first(codes, k + 1, ["codes"], F.asc_nulls_last("id"), F.asc("row"))
    candidates = cut_lineage(blocks(same, dealt, lists, width, "id"))
    queries = codes.where("asking")

    def meet(query_blocks: DataFrame) -> DataFrame:
        """Every block of queries beside every block of candidates, list by list.

        Codes compress well, so the files say little about the size of a block: no side is broadcast.
        """
        by_list = candidates.select("block", "rows", F.posexplode("parts").alias("part", "codes"))
        sent = query_blocks.select("*", F.explode(F.expr(f"sequence(0L, {dealt - 1}L)")).alias("block"))
        sent = sent.select("*", F.posexplode("parts").alias("part", "query_codes")).drop("parts", "ids")
        return sent.withColumnsRenamed({"rows": "asking"}).join(by_list.hint("merge"), ["block", "part"])

    plain = blocks(queries, query_dealt, lists, width).withColumnRenamed("block", "query_block")
    reach = min(k, math.ceil(GATHER * k / dealt))
    firsts = meet(plain).mapInArrow(gather(reach), "asks bigint, part int, row bigint, share bigint")
    firsts = _first(firsts, k, ["asks", "part"], F.desc("share"), F.asc("row")).select("asks", "row").distinct()
    one, other = codes.select("row", F.col("codes").alias("left")), codes.select(F.col("row").alias("asks"), F.col("codes").alias("right"))
    exact = F.aggregate(
        F.zip_with("left", "right", lambda a, b: F.coalesce(a * b, F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    scored = firsts.join(one, "row").join(other, "asks").select("asks", "row", exact.alias("score"))
    cutoffs = _first(scored, k, ["asks"], F.desc("score"), F.asc("row")).where(F.col("rank") == k)
    cutoffs = cutoffs.select(F.col("asks").alias("row"), F.col("score").alias("cutoff"))
    lowest = F.lit(-(2**62)).alias("cutoff")
    safe = queries.join(cutoffs, "row", "left").withColumn("cutoff", F.coalesce("cutoff", lowest))
    query_blocks = cut_lineage(
        blocks(safe, query_dealt, lists, width, "id", "cutoff").withColumnRenamed("block", "query_block")
    )
    entries = meet(query_blocks).mapInArrow(collect_entries(lists), ENTRIES_SQL)
    together = entries.groupBy("block", "query_block").agg(
        F.collect_list(F.struct("part", "query_at", "row_at", "shares")).alias("entries")
    )
    whole = query_blocks.withColumnsRenamed({"rows": "asking", "ids": "query_ids", "parts": "query_parts"})
    sums = together.join(candidates.hint("merge"), "block").join(whole.hint("merge"), "query_block").mapInArrow(
        resolve(k), "asks bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
    )
    best = _first(sums, k, ["asks"], F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row"))
    return best.select("query_id", "rank", "vec_id", "score")
