"""Two-dimensional array queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.sampling import uniform_from_digest
from millrace.operators import chunks, matrix
from millrace.operators.joins import inner_join
from millrace.sources.catalog import table


def trade_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Line-item revenue from supplier nation ``j`` to customer nation ``i``."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    sellers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    sales = inner_join(lines, sellers, ("l_suppkey", "s_suppkey"))
    sales = inner_join(inner_join(sales, orders, ("l_orderkey", "o_orderkey")), buyers, ("o_custkey", "c_custkey"))
    return sales.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(
        F.sum("l_extendedprice").alias("v")
    )


def add_transpose(spark: SparkSession, folder: str) -> DataFrame:
    both = matrix.add_transpose(trade_matrix(spark, folder))
    return both.select("i", "j", F.round("v", 2).alias("v"))


def slice_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The same sum taken cell by cell, then sliced and averaged."""
    trade = trade_matrix(spark, folder)
    side = table(spark, folder, "nation").agg(F.max("n_nationkey")).first()[0] + 1
    start = side // 2
    means = matrix.row_mean(matrix.slice2d(matrix.add_transpose(trade), 2, start), side - start)
    return means.select("i", F.round("mean", 2).alias("mean"))


def matrix_row_mean(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings as a square array, zero beyond their width: row means of ``(x + x.T)[::2, 32:]``."""
    vectors = table(spark, folder, "embeddings")
    side = vectors.agg(F.max("vec_id")).first()[0] + 1
    cells = matrix.from_vectors(vectors, "vec_id", "embedding")
    means = matrix.transpose_add_row_mean(cells, 2, 32, side - 32)
    return means.select("i", F.round("mean", 9).alias("mean"))


def chunked_row_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The same square array in 64 x 64 chunks, added to its transpose chunk by chunk."""
    vectors = table(spark, folder, "embeddings")
    side = vectors.agg(F.max("vec_id")).first()[0] + 1
    blocks = chunks.chunks_of(matrix.from_vectors(vectors, "vec_id", "embedding"), 64)
    means = chunks.row_mean(chunks.add_transpose(blocks, 64), 64, side, side - 32, 2, 32)
    return means.select("i", F.round("mean", 9).alias("mean"))


def random_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """A random value for every cell of the embeddings, rechunked by row: length, sum and peak of each row."""
    cells = matrix.from_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    value = uniform_from_digest(F.concat_ws("-", "i", "j"), "cell")
    drawn = matrix.rechunk(cells.select("i", "j", value.alias("v")), None, "i")
    return drawn.groupBy("i").agg(
        F.count("v").alias("cells"), F.round(F.sum("v"), 9).alias("total"), F.max("v").alias("peak")
    )


def rechunked(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings in 64 x 64 chunks, cut to 48 x 48 and to 40 x 40, and read back cell by cell."""
    vectors = table(spark, folder, "embeddings")
    blocks = chunks.chunks_of(matrix.from_vectors(vectors, "vec_id", "embedding"), 64)
    return chunks.cells_of(chunks.rechunk(chunks.rechunk(blocks, 64, 48), 48, 40), 40)


QUERIES = {
    "matrix_add_transpose": add_transpose,
    "matrix_slice_mean": slice_mean,
    "matrix_row_mean": matrix_row_mean,
    "matrix_chunked_mean": chunked_row_mean,
    "random_matrix_shape": random_matrix,
    "matrix_rechunk": rechunked,
}

_TRADE = """
    x AS (SELECT c_nationkey AS i, s_nationkey AS j, sum(l_extendedprice) AS v
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    y AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.v, 0) + coalesce(b.v, 0) AS v
          FROM x a FULL JOIN x b ON a.i = b.j AND a.j = b.i)"""

_ROW_MEAN = """
        WITH x AS (SELECT vec_id AS i, CAST(p - 1 AS BIGINT) AS j, CAST(embedding[p] AS DOUBLE) AS v
                   FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)),
        y AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.v, 0) + coalesce(b.v, 0) AS v
              FROM x a FULL JOIN x b ON a.i = b.j AND a.j = b.i)
        SELECT i, round(sum(v) / ((SELECT max(vec_id) + 1 FROM embeddings) - 32), 9) AS mean
        FROM y WHERE i % 2 = 0 AND j >= 32 GROUP BY i"""

ORACLES = {
    "matrix_add_transpose": f"WITH {_TRADE} SELECT i, j, round(v, 2) AS v FROM y",
    "matrix_slice_mean": f"""
        WITH {_TRADE}, s AS (SELECT max(n_nationkey) + 1 AS side FROM nation)
        SELECT i, round(sum(v) / any_value(side - side // 2), 2) AS mean
        FROM y, s WHERE i % 2 = 0 AND j >= side // 2 GROUP BY i""",
    "matrix_row_mean": _ROW_MEAN,
    "matrix_chunked_mean": _ROW_MEAN,
    "random_matrix_shape": """
        WITH c AS (SELECT vec_id AS i, unnest(range(0, len(embedding))) AS j FROM embeddings),
        v AS (SELECT i, CAST('0x' || substr(md5(i || '-' || j || '/cell'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS v FROM c)
        SELECT i, count(v) AS cells, round(sum(v), 9) AS total, max(v) AS peak FROM v GROUP BY i""",
    "matrix_rechunk": """
        SELECT vec_id AS i, CAST(p - 1 AS BIGINT) AS j, CAST(embedding[p] AS DOUBLE) AS v
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)
        WHERE embedding[p] <> 0""",
}
