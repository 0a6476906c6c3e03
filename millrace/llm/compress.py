"""Vector code compression: Lloyd's rounds over cover trees.

Each vector is cut into equal parts, and each part is replaced by the index of the nearest entry of
that part's codebook. All arithmetic is on integers and exact.

Rows are dealt to blocks of bounded size by a hash. For each block and part position one cover tree
is grown, once: a node has a point of its own, a radius that covers all points below it, children
that lie within half the radius of their own points, and, through cumulative sums over the points
in tree order, the sum of all its points. A round sends the codebooks to the trees: where the
distances from a node's point to the nearest and the next entry differ by more than twice the
radius, the triangle inequality gives the whole subtree to the nearest entry, and its sum is one
subtraction. Only other nodes descend, down to exact comparisons in the leaves. Copies of a part
are one node of radius zero. Spark adds up one row for each entry and task; the driver holds no more
than the codebooks.

Cases: vectors that are null or hold null or non-finite components are dropped. Vectors are filled
with zeros to the same length, a multiple of the number of parts. Fewer vectors than entries: as
many entries as vectors. Entries come from the smallest ids, null ids last, equal ids by their
components. Repeated rows are rows of their own. An empty table gives no rows. Columns other than
the id, the vector and the label do not matter. Squared distances are longs: tables with components
so large that one could pass 2^62 are refused.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import prepare_workers
from millrace.llm.vectors import blocks, bound_batches, flat, floored, n_blocks, usable
from millrace.session import cut_lineage

BLOCK_ROWS = 2048

# A node of at most so many points has no children.
LEAF = 8

TREES = pa.schema(
    [("part", pa.int32())]
    + [(name, pa.list_(pa.int64())) for name in ("rows", "points", "start", "end", "radius2", "child", "children")]
)
TREES_SQL = "part int, " + ", ".join(f"{name} array<bigint>" for name in TREES.names[1:])
RESULT = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances between rows that broadcast against each other."""
    return ((left - right) ** 2).sum(axis=-1)


class CoverTree:
    """Points in tree order and the nodes above them, level by level.

    Node i covers the points ``start[i]:end[i]``, the first of them is its own. Its children are the
    nodes ``child[i]:child[i] + children[i]``.
    """

    def __init__(self, points, start, end, radius2, child, children):
        self.points, self.start, self.end = points, start, end
        self.radius2, self.child, self.children = radius2, child, children
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])

    @classmethod
    def grow(cls, points: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree of some points, and the place each tree position had before."""
        order = np.arange(len(points))
        start, end, child, children = [0], [len(points)], [], []
        radius2 = [int(squared(points, points[0]).max())]
        node = 0
        while node < len(start):
            lo, hi, reach = start[node], end[node], radius2[node]
            child.append(len(start))
            if hi - lo > LEAF and reach:
                rest, at = order[lo:hi].copy(), lo
                while rest.size:
                    away = squared(points[rest], points[rest[0]])
                    near = 4 * away <= reach
                    own = rest[near]
                    order[at : at + own.size] = own
                    start.append(at)
                    end.append(at + own.size)
                    radius2.append(int(away[near].max()))
                    at += own.size
                    rest = rest[~near]
            children.append(len(start) - child[node])
            node += 1
        arrays = [np.array(x, dtype=np.int64) for x in (start, end, radius2, child, children)]
        return cls(points[order], *arrays), order

    def nearest(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of points and the entry nearest to all points of each run: starts, ends, entries."""
        nodes = np.zeros(1, dtype=np.int64)
        while nodes.size:
            away2 = squared(self.points[self.start[nodes], None, :], entries[None])
            best = away2.argmin(axis=1)
            away = np.sqrt(away2.astype(float))
            nearest = away[np.arange(nodes.size), best]
            away[np.arange(nodes.size), best] = np.inf
            radius = np.sqrt(self.radius2[nodes].astype(float))
            gap = away.min(axis=1) - nearest
            # Distances are rounded; the small share keeps the test on the safe side.
            sure = (radius == 0) | (gap > 2 * radius + 1e-9 * (2 * radius + 2 * nearest + 1) + 1e-9 * np.abs(gap))
            yield self.start[nodes[sure]], self.end[nodes[sure]], best[sure]
            open_nodes = nodes[~sure]
            inner = self.children[open_nodes] > 0
            leaves = open_nodes[~inner]
            at = spans(self.start[leaves], self.end[leaves] - self.start[leaves])
            if at.size:
                yield at, at + 1, squared(self.points[at, None, :], entries[None]).argmin(axis=1)
            nodes = spans(self.child[open_nodes[inner]], self.children[open_nodes[inner]])


def spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after the other."""
    if not first.size:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(first - (ends - lengths), lengths)


def grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            rows = flat(batch.column("rows"), at)
            tree, order = CoverTree.grow(flat(batch.column("codes"), at).reshape(len(rows), -1))
            row = {"part": batch.column("part")[at].as_py(), "rows": rows[order], "points": tree.points.ravel()}
            row |= {name: getattr(tree, name) for name in TREES.names[3:]}
            yield pa.RecordBatch.from_pylist([row], schema=TREES)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, CoverTree]]:
    for batch in batches:
        for at in range(batch.num_rows):
            rows = flat(batch.column("rows"), at)
            points = flat(batch.column("points"), at).reshape(len(rows), -1)
            nodes = [flat(batch.column(name), at) for name in TREES.names[3:]]
            yield batch.column("part")[at].as_py(), rows, CoverTree(points, *nodes)


def tally(codebooks: list[np.ndarray]):
    """The sum and number of the points of each entry, over all trees of a task."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(book) for book in codebooks]
        counts = [np.zeros(len(book), dtype=np.int64) for book in codebooks]
        for part, _, tree in _trees(batches):
            for start, end, entry in tree.nearest(codebooks[part]):
                np.add.at(sums[part], entry, tree.sums[end] - tree.sums[start])
                np.add.at(counts[part], entry, end - start)
        rows = [
            (part, entry, int(count), total.tolist())
            for part in range(len(codebooks))
            for entry, (count, total) in enumerate(zip(counts[part], sums[part], strict=True))
            if count
        ]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "entry", "n", "sums"), row, strict=True)) for row in rows],
            schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]),
        )

    return tallied


def assign(codebooks: list[np.ndarray]):
    """The entry of every part and its squared distance."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, tree in _trees(batches):
            entries = np.zeros(len(rows), dtype=np.int32)
            for start, end, entry in tree.nearest(codebooks[part]):
                entries[spans(start, end - start)] = np.repeat(entry, end - start)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows),
                    pa.array(np.full(len(rows), part, dtype=np.int32)),
                    pa.array(entries),
                    pa.array(squared(tree.points, codebooks[part][entries])),
                ],
                ["row", "part", "entry", "error"],
            )

    return assigned


def lloyd_round(trees: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment and update; unused entries stay."""
    made = trees.mapInArrow(tally(codebooks), "part int, entry int, n bigint, sums array<bigint>")
    totals = (
        made.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at")
        .agg(F.sum("value").alias("total"), F.sum("n").alias("n"))
    )
    moved = [book.copy() for book in codebooks]
    # One row for each component of the codebooks, however many vectors there are.
    for row in totals.collect():
        moved[row["part"]][row["entry"], row["at"]] = row["total"] // row["n"]
    return moved


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 4096,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector."""
    codes, codebooks, trees = fit(vectors, key, vector, label, scale, parts, entries, rounds)
    spark = vectors.sparkSession
    if codes is None:
        return spark.createDataFrame([], RESULT)
    numbers = ",".join(str(int(x)) for book in codebooks for x in book.ravel())
    found = trees.mapInArrow(assign(codebooks), "row bigint, part int, entry int, error bigint")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda e: F.lpad(F.lower(F.hex(e["entry"])), 2, "0"))
    whole = found.groupBy("row").agg(F.array_join(digits, "").alias("code"), F.sum("error").alias("error"))
    coded = cut_lineage(codes.select("row", "id", "label").join(whole, "row"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"),
        "code",
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def fit(vectors: DataFrame, key: str, vector: str, label: str, scale: int, parts: int, entries: int, rounds: int):
    """Stored codes, the codebooks after all rounds, and the stored trees; None for an empty table."""
    spark = vectors.sparkSession
    prepare_workers(spark)
    bound_batches(spark)
    codes = cut_lineage(
        vectors.where(usable(vector)).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{key}`").cast("bigint").alias("id"),
            F.col(f"`{label}`").alias("label"),
            floored(vector, scale).alias("codes"),
        )
    )
    low, high = F.array_min("codes"), F.array_max("codes")
    n, length, largest = codes.agg(
        F.count("*"), F.max(F.size("codes")), F.max(F.greatest(-low.cast("double"), high.cast("double")))
    ).first()
    if not n:
        return None, None, None
    width = max(1, math.ceil(length / parts))
    if (2 * (largest or 0.0)) ** 2 * width * parts >= 2**62:
        raise ValueError("the components are too large for squared distances that are longs")
    first = codes.orderBy(F.asc_nulls_last("id"), "codes").limit(entries).select("codes").collect()
    padded = np.array([r["codes"] + [0] * (parts * width - len(r["codes"])) for r in first], dtype=np.int64)
    codebooks = [padded[:, p * width : (p + 1) * width] for p in range(parts)]
    dealt = blocks(codes, n_blocks(n, BLOCK_ROWS), parts, width)
    by_part = dealt.select("rows", F.posexplode("parts").alias("part", "codes"))
    trees = cut_lineage(by_part.mapInArrow(grow_trees, TREES_SQL))
    for _ in range(rounds):
        codebooks = lloyd_round(trees, codebooks)
    return codes, codebooks, trees
