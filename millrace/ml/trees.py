"""Second-order boosted trees on quantile bins, trained level by level on cached blocks of rows.

Features become bin numbers of one byte once. In a round every level costs one Spark job: each task adds up the
gradients and curvatures of its rows for every open node, feature and bin, the tables of each node meet
in one task, which adds them up and picks the best split, and the driver gets only the splits. Rows never move after binning. Tasks keep the margins of their rows between jobs where
they can, and compute them again from the finished trees where they cannot (another worker, a lost
executor), so nothing has to be written between rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from millrace.session import cut_lineage

# Bins of a feature; one more holds missing values.
BINS = 64
BLOCK_ROWS = 1 << 16


@dataclass
class Tree:
    """Nodes as arrays; a node without a left child is a leaf. Rows with ``bin <= cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while True:
            inner = self.left[node[rows]] > 0
            rows = rows[inner]
            if not rows.size:
                return node
            at = node[rows]
            right = bins[rows, self.feature[at]] > self.cut[at]
            node[rows] = self.left[at] + right

    def add_to(self, margin: np.ndarray, bins: np.ndarray) -> None:
        margin += self.value[self.nodes(bins)]


def quantile_cuts(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Ascending cut points of every feature; a value's bin is the number of cuts below it."""
    fractions = [i / BINS for i in range(1, BINS)]
    wanted = [F.percentile_approx(F.col(f"`{f}`").cast("double"), fractions, 10_000).alias(f"q{i}") for i, f in enumerate(features)]
    found = df.agg(*wanted).first()
    return [np.unique(np.array([x for x in (found[i] or []) if x == x], dtype=float)) for i in range(len(features))]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix of values; missing values get the last bin."""
    bins = np.empty(values.shape, dtype=np.uint8)
    for i, cut in enumerate(cuts):
        bins[:, i] = np.where(np.isnan(values[:, i]), BINS, np.searchsorted(cut, values[:, i], side="left"))
    return bins


# Margins of the rows of one fit that this worker has seen: partition and block -> rounds, margins.
_MARGINS: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
_FIT = ""


def _margin(fit: str, place: tuple[int, int], bins: np.ndarray, base: float, finished: list) -> np.ndarray:
    global _FIT
    if _FIT != fit:
        _MARGINS.clear()
        _FIT = fit
    rounds, margin = _MARGINS.get(place, (0, None))
    if margin is None or rounds > len(finished):
        rounds, margin = 0, np.full(len(bins), base)
    for tree in finished[rounds:]:
        tree.value.add_to(margin, bins)
    _MARGINS[place] = (len(finished), margin)
    return margin


def _level_sums(fit: str, base: float, finished: list, tree: Tree, open_nodes: np.ndarray, features: int):
    """Sums of gradients and curvatures by open node, feature and bin, over the blocks of a task."""
    slot = np.full(len(tree.left), -1)
    slot[open_nodes] = np.arange(len(open_nodes))
    width = features * (BINS + 1)

    def sums(part: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        total = np.zeros((2, len(open_nodes) * width))
        for number, (bins, label) in enumerate(blocks):
            margin = _margin(fit, (part, number), bins, base, finished)
            chance = 1 / (1 + np.exp(-margin))
            at = slot[tree.nodes(bins)]
            rows = np.flatnonzero(at >= 0)
            if not rows.size:
                continue
            cell = at[rows, None] * width + np.arange(features) * (BINS + 1) + bins[rows]
            for kind, weight in enumerate((chance - label, chance * (1 - chance))):
                spread = np.broadcast_to(weight[rows, None], cell.shape).ravel()
                total[kind] += np.bincount(cell.ravel(), spread, minlength=total.shape[1])
        yield total

    return sums


def _best_splits(sums: np.ndarray, features: int, smooth: float, least: float) -> tuple[np.ndarray, ...]:
    """Gain, feature and cut of the best split of every open node, its own sums and those of its left child."""
    g, h = sums.reshape(2, -1, features, BINS + 1)
    whole_g, whole_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    left_g, left_h = g.cumsum(axis=2)[..., :-1], h.cumsum(axis=2)[..., :-1]
    right_g, right_h = whole_g[:, None, None] - left_g, whole_h[:, None, None] - left_h
    gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - (whole_g**2 / (whole_h + smooth))[:, None, None]
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf).reshape(len(whole_g), -1)
    best = gain.argmax(axis=1)
    nodes, feature, cut = np.arange(len(best)), best // BINS, best % BINS
    return gain[nodes, best], feature, cut, whole_g, whole_h, left_g[nodes, feature, cut], left_h[nodes, feature, cut]


class BoostedTrees:
    """A fitted model; ``transform`` adds ``rawPrediction`` (the margin), ``probability`` and ``prediction``."""

    def __init__(self, features: list[str], cuts: list[np.ndarray], base: float, trees: list[Tree]):
        self.features, self.cuts, self.base, self.trees = features, cuts, base, trees

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        margin = np.full(len(values), self.base)
        for tree in self.trees:
            tree.add_to(margin, bins)
        return margin

    def transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(model.value.margins(batch.to_numpy(dtype=float)))

        inputs = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]
        scored = df.withColumn("rawPrediction", margin(F.struct(*inputs)))
        chance = 1 / (1 + F.exp(-F.col("rawPrediction")))
        return scored.withColumn("probability", chance).withColumn("prediction", (F.col("rawPrediction") > 0).cast("double"))


def fit_trees(
    df: DataFrame,
    features: list[str],
    label: str,
    rounds: int = 100,
    depth: int = 8,
    rate: float = 0.1,
    smooth: float = 0.1,
    least: float = 0.1,
) -> BoostedTrees:
    """Boosted trees for the logistic loss. ``label`` holds 0 and 1, rows without label are left out.

    ``smooth`` is added to the curvature of every node, ``least`` is the curvature a child needs.
    """
    spark = df.sparkSession
    rows = df.where(F.col(f"`{label}`").isNotNull())
    cuts = quantile_cuts(rows, features)
    width = len(features)

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = binned(batch.iloc[:, :width].to_numpy(dtype=float), cuts)
            yield pd.DataFrame({"bins": [bins.tobytes()], "label": [batch.iloc[:, width].to_numpy(dtype=np.uint8).tobytes()]})

    narrow = rows.select(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(f"`{label}`").cast("int").alias("label"))
    stored = cut_lineage(narrow.mapInPandas(to_blocks, "bins BINARY, label BINARY"))

    def gathered(blocks: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches put together to blocks of bounded size."""
        bins, labels, size = [], [], 0
        for row in blocks:
            bins.append(np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, width))
            labels.append(np.frombuffer(row["label"], dtype=np.uint8).astype(float))
            size += len(labels[-1])
            if size >= BLOCK_ROWS:
                yield np.concatenate(bins), np.concatenate(labels)
                bins, labels, size = [], [], 0
        if size:
            yield np.concatenate(bins), np.concatenate(labels)

    count, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(f"`{label}`").cast("bigint")), F.lit(0))).first()
    if not count:
        return BoostedTrees(features, cuts, 0.0, [])
    share = min(max(ones / count, 1e-6), 1 - 1e-6)
    settings = Settings(width, float(np.log(share / (1 - share))), rounds, depth, rate, smooth, least)
    # Tasks of at least one block of rows: a job's fixed cost is paid once for each.
    blocks = stored.coalesce(max(1, count // BLOCK_ROWS)).rdd.mapPartitions(gathered)
    if count <= BLOCK_ROWS:
        # All rows are one block: one task runs all rounds, with the same sums.
        trees = blocks.mapPartitions(_rounds_of_one_task(settings)).collect()
    else:
        trees = _rounds_of_jobs(blocks.persist(StorageLevel.MEMORY_AND_DISK), settings)
    return BoostedTrees(features, cuts, settings.base, trees)


@dataclass
class Settings:
    width: int
    base: float
    rounds: int
    depth: int
    rate: float
    smooth: float
    least: float


def _rounds_of_jobs(blocks, settings: Settings) -> list[Tree]:
    """All rounds, with a job over the cached blocks for each level."""

    parts, width = blocks.getNumPartitions(), settings.width

    def by_node(task, nodes: int):
        def cut(part: int, own: Iterator) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            for table in task(part, own):
                for slot, sums in enumerate(np.split(table, nodes, axis=1)):
                    yield (slot, part), sums

        return cut

    def splits_of(tables: Iterator[tuple[tuple[int, int], np.ndarray]]) -> Iterator[tuple[int, list[float]]]:
        """Tables come by node and then by part, so sums do not depend on which part is ready first."""
        for slot, group in groupby(tables, key=lambda entry: entry[0][0]):
            total = reduce(np.add, (table for _, table in group))
            yield slot, [float(x[0]) for x in _best_splits(total, width, settings.smooth, settings.least)]

    def splits(task, nodes: int) -> tuple[np.ndarray, ...]:
        tables = blocks.mapPartitionsWithIndex(by_node(task, nodes))
        met = tables.repartitionAndSortWithinPartitions(min(nodes, parts), lambda key: key[0])
        found = np.array([split for _, split in sorted(met.mapPartitions(splits_of).collect())]).T
        return found[0], found[1].astype(np.int64), found[2].astype(np.int64), *found[3:]

    finished = []
    try:
        fit = uuid.uuid4().hex
        for _ in range(settings.rounds):
            finished.append(blocks.context.broadcast(_grow(splits, fit, finished, settings)))
        return [tree.value for tree in finished]
    finally:
        for tree in finished:
            tree.destroy()
        blocks.unpersist()


@dataclass
class Plain:
    """A tree where no broadcast is needed."""

    value: Tree


def _rounds_of_one_task(settings: Settings):
    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[Tree]:
        own, fit, finished = list(blocks), uuid.uuid4().hex, []

        def splits(task, _: int) -> tuple[np.ndarray, ...]:
            return _best_splits(next(task(0, iter(own))), settings.width, settings.smooth, settings.least)

        for _ in range(settings.rounds):
            finished.append(Plain(_grow(splits, fit, finished, settings)))
        yield from (tree.value for tree in finished)

    return run


def _grow(splits_of, fit: str, finished: list, settings: Settings) -> Tree:
    """One tree; ``splits_of`` gives the best splits of the open nodes from what a task function yields over all blocks."""
    width, rate, smooth, least = settings.width, settings.rate, settings.smooth, settings.least
    tree = Tree(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1))
    open_nodes = np.zeros(1, dtype=np.int64)
    for _ in range(settings.depth):
        task = _level_sums(fit, settings.base, finished, tree, open_nodes, width)
        gain, feature, cut, g, h, left_g, left_h = splits_of(task, len(open_nodes))
        tree.value[open_nodes] = -rate * g / (h + smooth)
        splits = gain > 1e-9
        parents = open_nodes[splits]
        if not parents.size:
            break
        children = len(tree.left) + np.arange(2 * parents.size)
        tree.feature[parents], tree.cut[parents], tree.left[parents] = feature[splits], cut[splits], children[::2]
        # A child's value comes from the split, so the last level needs no sums of its own.
        child_g = np.stack([left_g[splits], (g - left_g)[splits]], axis=1).ravel()
        child_h = np.stack([left_h[splits], (h - left_h)[splits]], axis=1).ravel()
        none = np.zeros(children.size, np.int64)
        tree.feature, tree.cut, tree.left = (np.append(old, none) for old in (tree.feature, tree.cut, tree.left))
        tree.value = np.append(tree.value, -rate * child_g / (child_h + smooth))
        # A node whose curvature cannot give two children of the least curvature is closed.
        open_nodes = children[child_h >= 2 * least]
        if not open_nodes.size:
            break
    return tree
