"""Tree, forest and boosting on collapsed training rows.

Trees see a row only through its label columns and the bin of its numbers, and squared errors need only counts and sums.
So the training rows collapse, in one grouped aggregation, to one cell per combination, with its rows and its mean
target. Where the counted cells stay within a bound, one task grows all trees of a fit from them; several fits
run beside each other. Beyond the bound cells stay spread over tasks (``spread_trees``) or the fit goes to Spark ML's distributed learner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import c

BINS = 32
#: Most cells that one task holds: some 20 MB.
MOST_CELLS = 200_000
FOREST_MB = 1_024
HAIR = 1e-9
TREE_SCHEMA = "tree int, split_feature array<int>, split_code array<int>, split_gain array<double>, leaf array<double>"


@dataclass
class Tree:
    """A complete binary tree: inner nodes level by level, then leaves. Feature -1 sends every row left."""

    feature: np.ndarray
    code: np.ndarray
    gain: np.ndarray
    leaf: np.ndarray

    def leaves(self, codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        node = np.zeros(codes.shape[1], np.int64)
        for _ in range(int(np.log2(len(self.leaf)))):
            node = 2 * node + 1 + goes_right(codes, ordered, self.feature[node], self.code[node])
        return node - len(self.feature)


def goes_right(codes: np.ndarray, ordered: np.ndarray, feature: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Numbers go right above the split bin, labels unless they are the split label."""
    value = codes[feature, np.arange(codes.shape[1])]
    return (feature >= 0) & np.where(ordered[feature], value > code, value != code)


def best_codes(wl: np.ndarray, gl: np.ndarray, whole_w: np.ndarray, whole_g: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code and gain of each node's best split from its sums per code."""
    if ordered:
        wl, gl = wl.cumsum(axis=1), gl.cumsum(axis=1)
    wr, gr = whole_w - wl, whole_g - gl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((wl >= 1) & (wr >= 1), gl * gl / wl + gr * gr / wr - whole_g * whole_g / whole_w, 0.0)
    # Gains within a hair are equal, so that the order of summation decides nothing.
    top = (gain >= gain.max(axis=1, keepdims=True) * (1 - HAIR)).argmax(axis=1)
    return top, gain[np.arange(len(top)), top]


def _splits(codes: np.ndarray, levels: list[int], ordered: np.ndarray, node: np.ndarray, nodes: int, w: np.ndarray, g: np.ndarray):
    """Best split of each node: feature, code and gain. Equal gains go to the first feature and the lowest code."""
    feature, code, best = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, 1e-9)
    for f, size in enumerate(levels):
        at = node * size + codes[f]
        wl, gl = np.bincount(at, w, nodes * size).reshape(nodes, size), np.bincount(at, g, nodes * size).reshape(nodes, size)
        top, found = best_codes(wl, gl, wl.sum(axis=1, keepdims=True), gl.sum(axis=1, keepdims=True), ordered[f])
        better = found > best * (1 + HAIR)
        feature[better], code[better], best[better] = f, top[better], found[better]
    return feature, code, np.where(feature >= 0, best, 0.0)


def grown(codes: np.ndarray, levels: list[int], ordered: np.ndarray, w: np.ndarray, g: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """A least-squares tree of the cells' weighted residual sums ``g``, and the leaf of each cell."""
    node, start, parts = np.zeros(len(w), np.int64), 0, []
    for level in range(depth):
        nodes = 1 << level
        found = _splits(codes, levels, ordered, node, nodes, w, g)
        parts.append(found)
        node = 2 * node + goes_right(codes, ordered, found[0][node], found[1][node])
    weight, total = np.bincount(node, w, 1 << depth), np.bincount(node, g, 1 << depth)
    leaf = np.divide(total, weight, out=np.zeros(1 << depth), where=weight > 0)
    return Tree(*(np.concatenate(p) for p in zip(*parts)), leaf), node


def boosted(grow: Callable, n: np.ndarray, mean: np.ndarray, trees: int, step: float, subsample: float, rng: np.random.Generator) -> Iterator[Tree]:
    """Trees of the residuals. Each round draws the share ``subsample`` of each cell's rows."""
    predicted = np.full(len(n), float((n * mean).sum() / n.sum()))
    for _ in range(trees):
        w = rng.binomial(n, subsample).astype(float)
        tree, leaf = grow(w, w * (mean - predicted))
        predicted += step * tree.leaf[leaf]
        yield tree


def bagged(grow: Callable, n: np.ndarray, mean: np.ndarray, trees: int, rng: np.random.Generator) -> Iterator[Tree]:
    """Trees of bootstrap draws: a cell's rows are drawn a Poisson number of times each, so their sum is Poisson too."""
    for _ in range(trees):
        w = rng.poisson(n).astype(float)
        yield grow(w, w * mean)[0]


def _fit(ordered: np.ndarray, levels: list[int], learner: CellTrees) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(list(cells.columns), ignore_index=True)  # the draw must not depend on the shuffle
        codes = cells[[f"code_{i}" for i in range(len(levels))]].to_numpy(np.int64).T
        n, mean, rng = cells["n"].to_numpy(np.int64), cells["mean"].to_numpy(float), np.random.default_rng(learner.seed)

        def grow(w: np.ndarray, g: np.ndarray) -> tuple[Tree, np.ndarray]:
            return grown(codes, levels, ordered, w, g, learner.depth)

        trees = {"tree": lambda: [grow(n.astype(float), n * mean)[0]], "forest": lambda: bagged(grow, n, mean, learner.trees, rng),
                 "boosting": lambda: boosted(grow, n, mean, learner.trees, learner.step, learner.subsample, rng)}[learner.kind]()
        rows = [(k, t.feature.tolist(), t.code.tolist(), t.gain.tolist(), t.leaf.tolist()) for k, t in enumerate(trees)]
        start = float((n * mean).sum() / n.sum())
        return pd.DataFrame([*rows, (-1, [], [], [], [start])], columns=["tree", "split_feature", "split_code", "split_gain", "leaf"])
    return run


def _bin(name: str, edges: list[float]) -> Column:
    """Count of edges below a number, as the model's search finds it."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge < c(name))) if edges else F.lit(0)


@dataclass
class CellModel:
    """Start value, weight of each tree, trees, and the codes of each feature: bin edges of a number, sorted levels of a label column."""

    start: float
    step: float
    trees: list[Tree]
    columns: list[str]
    edges: list[list]
    ordered: np.ndarray

    def predicted(self) -> Column:
        """Prediction of a row from its feature columns; a level not seen in training is like no level."""
        start, step, trees, edges, ordered = self.start, self.step, self.trees, self.edges, self.ordered

        @F.pandas_udf("double")
        def predict(frame: pd.DataFrame) -> pd.Series:
            codes = np.stack([
                np.searchsorted(e, frame.iloc[:, i].to_numpy(float)) if o else pd.Index(e).get_indexer(frame.iloc[:, i])
                for i, (e, o) in enumerate(zip(edges, ordered))
            ])
            if not len(frame):
                return pd.Series([], dtype=float)
            # Rows of equal codes share a prediction; numbered column by column, so that numbers stay small.
            same = np.zeros(len(frame), np.int64)
            for row in codes:
                same = np.unique(same * (row.max() + 2) + row + 1, return_inverse=True)[1]
            codes = codes[:, np.unique(same, return_index=True)[1]]
            out = np.full(codes.shape[1], start)
            for tree in trees:
                out += step * tree.leaf[tree.leaves(codes, ordered)]
            return pd.Series(out[same])

        return predict(F.struct(*[c(n) for n in self.columns]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("out", self.predicted())

    def effects(self) -> list[tuple[str, str | None, float]]:
        """(column, level, share of the gain); numbers have no level."""
        total: dict[tuple, float] = {}
        for tree in self.trees:
            for f, code, gain in zip(tree.feature, tree.code, tree.gain):
                if f >= 0:
                    key = (self.columns[f], None if self.ordered[f] else self.edges[f][code])
                    total[key] = total.get(key, 0.0) + float(gain)
        whole = sum(total.values())
        return [(*key, gain / whole) for key, gain in total.items()]


@dataclass(frozen=True)
class Cells:
    """Collapsed training rows: codes of the features, rows ``n`` and the mean of each target."""

    table: DataFrame
    columns: list[str]
    edges: list[list]
    ordered: np.ndarray

    def release(self) -> None:
        self.table.unpersist()


def binned_cells(train: DataFrame, targets: Sequence[str]) -> tuple[DataFrame, list[str], list[str], list[list]]:
    """One row per combination of the columns ``num_*``, in bins, and ``cat_*``, with its rows and mean targets; the columns, and the bins' edges.

    All targets share one aggregation, combined before its shuffle.
    """
    numbers, labels = ([n for n in train.columns if n.startswith(p)] for p in ("num_", "cat_"))
    edges: list[list] = []
    if numbers:
        shares = [k / BINS for k in range(1, BINS)]
        found = train.agg(*[F.percentile_approx(c(n), shares, 10_000).alias(n) for n in numbers]).first()
        edges = [sorted(set(found[n])) for n in numbers]
    binned = train.select(*[_bin(n, e).alias(n) for n, e in zip(numbers, edges)], *[c(n) for n in labels], *[c(t) for t in targets])
    cells = binned.groupBy(*[c(k) for k in (*numbers, *labels)]).agg(F.count("*").alias("n"), *[F.avg(c(t)).alias(t) for t in targets])
    return cells, numbers, labels, edges


def label_levels(cells: DataFrame, labels: Sequence[str]) -> dict[str, list]:
    """Sorted levels of the label columns."""
    return cells.agg(*[F.array_sort(F.collect_set(c(n))).alias(n) for n in labels]).first().asDict() if labels else {}


def collapse(train: DataFrame, targets: Sequence[str], most_cells: int = MOST_CELLS) -> Cells | None:
    """One cell per combination of the columns ``num_*``, in bins, and ``cat_*``; None if they are more than ``most_cells``."""
    cells, numbers, labels, edges = binned_cells(train, targets)
    cells, keys = cells.persist(), [*numbers, *labels]
    if cells.limit(most_cells + 1).count() > most_cells:
        cells.unpersist()
        return None
    levels = label_levels(cells, labels)
    edges += [levels[n] for n in labels]
    coded = [c(n) for n in numbers] + [F.array_position(F.array(*map(F.lit, levels[n])), c(n)) - 1 for n in labels]
    table = cells.select(*[v.cast("int").alias(f"code_{i}") for i, v in enumerate(coded)], "n", *[c(t) for t in targets]).persist()
    table.count()
    cells.unpersist()
    return Cells(table, keys, edges, np.array([True] * len(numbers) + [False] * len(labels)))


@dataclass(frozen=True)
class CellTrees:
    """A learner over the columns ``num_*`` and ``cat_*`` of a training table with a ``label``: one tree, a forest, or boosting."""

    kind: str
    depth: int
    seed: int
    trees: int = 1
    step: float = 1.0
    subsample: float = 1.0
    most_cells: int = MOST_CELLS

    def distributed(self) -> Estimator:
        """Spark ML's learner of the same settings, for cells too many for one task."""
        named = {"featuresCol": "features", "labelCol": "label", "predictionCol": "out", "maxDepth": self.depth, "seed": self.seed}
        if self.kind == "boosting":
            return GBTRegressor(maxIter=self.trees, stepSize=self.step, subsamplingRate=self.subsample, **named)
        if self.kind == "forest":
            return RandomForestRegressor(numTrees=self.trees, featureSubsetStrategy="all", maxMemoryInMB=FOREST_MB, **named)
        return DecisionTreeRegressor(**named)

    def fit(self, train: DataFrame, cells: Cells | None = None, target: str = "label"):
        """Trees from the cells of ``train`` (collapsed here if not given), or Spark ML's model of the same settings where they are too many."""
        own = collapse(train, [target], self.most_cells) if cells is None else cells
        if own is None:
            return self.distributed().fit(train.withColumn("label", c(target)))
        try:
            return self._grown(own, target)
        finally:
            if cells is None:
                own.release()

    def _grown(self, cells: Cells, target: str) -> CellModel:
        coded = [n for n in cells.table.columns if n.startswith("code_")]
        sizes = [len(e) + int(o) for e, o in zip(cells.edges, cells.ordered)]
        table = cells.table.select(*coded, "n", c(target).alias("mean"))
        rows = table.groupBy().applyInPandas(_fit(cells.ordered, sizes, self), TREE_SCHEMA).collect()
        found = {r["tree"]: Tree(*(np.array(r[k]) for k in ("split_feature", "split_code", "split_gain", "leaf"))) for r in rows}
        start = float(found.pop(-1).leaf[0])
        trees = [found[k] for k in sorted(found)]
        start, step = (start, self.step) if self.kind == "boosting" else (0.0, 1 / len(trees))
        return CellModel(start, step, trees, cells.columns, cells.edges, cells.ordered)
