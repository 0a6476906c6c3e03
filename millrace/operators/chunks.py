"""Dense two-dimensional arrays as square chunks ``(bi, bj, data)``.

``data`` holds ``side * side`` doubles, row by row; chunks at the edge are padded
with zeros. Spark places, shuffles and pairs the chunks, numpy works inside one
chunk at a time. A shuffled cell costs eight bytes here and three columns in the
long form, so this is the form for arrays that have to be kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = "bi BIGINT, bj BIGINT, data BINARY"
SUBTOTAL = "i BIGINT, total DOUBLE"


def _values(data: bytes, side: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(side, side)


def random_chunks(spark: SparkSession, rows: int, cols: int, side: int, seed: int = 42) -> DataFrame:
    """Uniform values in [0, 1), eight chunks to a task; a chunk's values depend on its place only."""
    across = -(-cols // side)
    count = -(-rows // side) * across

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                bi, bj = divmod(int(number), across)
                values = np.random.Generator(np.random.Philox(key=[seed, number])).random((side, side))
                values[max(0, rows - bi * side) :, :] = 0.0
                values[:, max(0, cols - bj * side) :] = 0.0
                yield pd.DataFrame({"bi": [bi], "bj": [bj], "data": [values.tobytes()]})

    return spark.range(0, count, 1, -(-count // 8)).mapInPandas(make, CHUNK)


def chunks_of(cells: DataFrame, side: int) -> DataFrame:
    """Gather cells ``(i, j, v)`` into chunks; no group is larger than one chunk."""

    def fill(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((side, side))
        values[block["r"].to_numpy(), block["c"].to_numpy()] = block["v"].to_numpy()
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "data": [values.tobytes()]})

    placed = cells.select(
        F.expr(f"i div {side}").alias("bi"),
        F.expr(f"j div {side}").alias("bj"),
        (F.col("i") % side).alias("r"),
        (F.col("j") % side).alias("c"),
        "v",
    )
    return placed.groupBy("bi", "bj").applyInPandas(fill, CHUNK)


PIECE = "bi BIGINT, bj BIGINT, top INT, `left` INT, height INT, width INT, data BINARY"


def rechunk(chunks: DataFrame, side: int, new_side: int) -> DataFrame:
    """The same array in chunks of another side.

    Every chunk is cut along the new grid, and the pieces of a new chunk are put together: a group holds one
    chunk's worth of cells, and cells never become rows. New chunks that would hold padding only
    are left out.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bi, bj, data in zip(batch["bi"], batch["bj"], batch["data"]):
                values, pieces = _values(data, side), []
                for ni, (top, bottom) in _grid(bi * side, side, new_side):
                    for nj, (left, right) in _grid(bj * side, side, new_side):
                        part = values[top - bi * side : bottom - bi * side, left - bj * side : right - bj * side]
                        if part.any():
                            pieces.append((ni, nj, top - ni * new_side, left - nj * new_side, *part.shape, part.tobytes()))
                yield pd.DataFrame(pieces, columns=["bi", "bj", "top", "left", "height", "width", "data"])

    def join(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((new_side, new_side))
        for piece in pieces.itertuples():
            part = np.frombuffer(piece.data, dtype=np.float64).reshape(piece.height, piece.width)
            values[piece.top : piece.top + piece.height, piece.left : piece.left + piece.width] = part
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "data": [values.tobytes()]})

    return chunks.mapInPandas(cut, PIECE).groupBy("bi", "bj").applyInPandas(join, CHUNK)


def _grid(start: int, length: int, side: int) -> list[tuple[int, tuple[int, int]]]:
    """The chunks of a grid that a stretch meets, each with the part of the stretch in it."""
    numbers = range(start // side, (start + length - 1) // side + 1)
    return [(n, (max(start, n * side), min(start + length, (n + 1) * side))) for n in numbers]


def cells_of(chunks: DataFrame, side: int) -> DataFrame:
    """The cells ``(i, j, v)`` of all chunks that are not zero."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bi, bj, data in zip(batch["bi"], batch["bj"], batch["data"]):
                values = _values(data, side)
                i, j = np.nonzero(values)
                yield pd.DataFrame({"i": bi * side + i, "j": bj * side + j, "v": values[i, j]})

    return chunks.mapInPandas(spread, "i BIGINT, j BIGINT, v DOUBLE")


def add_transpose(chunks: DataFrame, side: int) -> DataFrame:
    """``x + x.T``: every chunk meets its mirror image by position, two chunks to a group."""

    def add(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((side, side))
        for data, mirrored in zip(pair["data"], pair["mirrored"]):
            block = _values(data, side)
            values += block.T if mirrored else block
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "data": [values.tobytes()]})

    straight = chunks.select("bi", "bj", "data", F.lit(False).alias("mirrored"))
    mirrored = chunks.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "data", F.lit(True).alias("mirrored"))
    return straight.unionByName(mirrored).groupBy("bi", "bj").applyInPandas(add, CHUNK)


def _slice_totals(
    values: np.ndarray, top: int, left: int, rows: int, row_step: int, col_start: int
) -> pd.DataFrame:
    """Row subtotals of the part of one chunk that lies in ``[:rows:row_step, col_start:]``."""
    positions = np.arange(top, min(top + len(values), rows))
    kept = positions[positions % row_step == 0]
    totals = values[kept - top, max(0, col_start - left) :].sum(axis=1)
    return pd.DataFrame({"i": kept, "total": totals})


def row_mean(
    chunks: DataFrame, side: int, rows: int, width: int, row_step: int = 1, col_start: int = 0, name: str = "mean"
) -> DataFrame:
    """Row means of ``x[::row_step, col_start:]``: chunks outside are skipped, subtotals are shuffled."""

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bi, bj, data in zip(batch["bi"], batch["bj"], batch["data"]):
                yield _slice_totals(_values(data, side), bi * side, bj * side, rows, row_step, col_start)

    inside = chunks.where(F.col("bj") >= col_start // side)
    subtotals = inside.mapInPandas(totals, SUBTOTAL)
    return subtotals.groupBy("i").agg((F.sum("total") / F.lit(width)).alias(name))


def transpose_add_row_mean(
    chunks: DataFrame, side: int, rows: int, row_step: int, col_start: int, width: int, name: str = "mean"
) -> DataFrame:
    """Row means of ``(x + x.T)[::row_step, col_start:]`` of a square array.

    A chunk adds to the rows it lies in and, mirrored, to the rows of its columns;
    only those subtotals leave the task.
    """

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bi, bj, data in zip(batch["bi"], batch["bj"], batch["data"]):
                values = _values(data, side)
                yield _slice_totals(values, bi * side, bj * side, rows, row_step, col_start)
                yield _slice_totals(values.T, bj * side, bi * side, rows, row_step, col_start)

    subtotals = chunks.mapInPandas(totals, SUBTOTAL)
    return subtotals.groupBy("i").agg((F.sum("total") / F.lit(width)).alias(name))
