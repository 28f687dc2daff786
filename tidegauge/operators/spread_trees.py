"""Tree, forest and boosting on collapsed rows that are too many for one task.

The cells are dealt over tasks by the widest label column and cached as arrays. A level of a tree is one job: tasks send sums per node and
code of the narrow columns, and the best level of the wide column, all of whose rows they have. Nodes and predictions
follow from the narrow columns' combination, except for the few wide levels that split something, so the tasks keep no state.
All targets of a learner grow side by side, a forest's trees in batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import c
from tidegauge.operators.cell_trees import HAIR, CellModel, CellTrees, Tree, best_codes, binned_cells, goes_right, label_levels

#: Draws belong to a bucket of cells, so that they don't depend on the number of tasks.
BUCKETS = 256
#: Most levels of a label column whose sums every task sends; the widest column may have any number.
NARROW_LEVELS = 256
#: Most combinations of the narrow columns: the driver follows each through the trees.
MOST_KINDS = 4_096
#: Trees of a forest that one job works on.
BATCH = 25


@dataclass(frozen=True)
class SpreadCells:
    """Cells over many tasks, packed as one ``Share`` a partition, and the codes of all combinations of numbers and narrow labels."""

    shares: RDD
    columns: list[str]
    edges: list[list]
    ordered: np.ndarray
    wide: int | None
    kinds: np.ndarray
    targets: tuple[str, ...]
    table: DataFrame

    def release(self) -> None:
        self.shares.unpersist()
        self.table.unpersist()


def spread_cells(train: DataFrame, targets: Sequence[str]) -> SpreadCells | None:
    """Cells of the columns ``num_*`` and ``cat_*``; None where several label columns are wide or the others have too many combinations."""
    cells, numbers, labels, edges = binned_cells(train, targets)
    cells = cells.persist()
    sizes = cells.agg(F.count("*").alias("z"), *[F.count_distinct(c(n)).alias(n) for n in labels]).first()
    broad = [n for n in labels if sizes[n] > NARROW_LEVELS]
    if len(broad) > 1:
        cells.unpersist()
        return None
    narrow = [n for n in labels if n not in broad]
    levels = label_levels(cells, narrow)
    edges += [[] if n in broad else levels[n] for n in labels]
    keys = [*numbers, *labels]
    coded = [F.array_position(F.array(*map(F.lit, levels[n])), c(n)) - 1 if n in narrow else c(n) for n in keys]
    typed = [v if n in broad else v.cast("int") for n, v in zip(keys, coded)]
    others = [n for n in keys if n not in broad]
    kinds = cells.select(*[typed[keys.index(n)].alias(n) for n in others]).distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        cells.unpersist()
        return None
    kinds = np.array(sorted(tuple(r) for r in kinds), np.int64).reshape(len(kinds), len(others)).T
    bucket = F.pmod(F.xxhash64(*[c(n) for n in broad or keys]), F.lit(BUCKETS)).cast("int").alias("bucket")
    table = cells.select(bucket, *[v.alias(f"code_{i}") for i, v in enumerate(typed)], "n", *[c(t).alias(f"mean_{i}") for i, t in enumerate(targets)]).persist()
    table.count()
    cells.unpersist()
    wide = keys.index(broad[0]) if broad else None
    return SpreadCells(_shared(table, kinds, wide, len(targets)), keys, edges, np.array([True] * len(numbers) + [False] * len(labels)), wide, kinds, tuple(targets), table)


@dataclass
class Share:
    """The cells of one partition, sorted so that draws don't depend on their arrival."""

    names: np.ndarray
    owner: np.ndarray
    kind: np.ndarray
    n: np.ndarray
    means: list[np.ndarray]
    buckets: list[tuple[int, int]]
    first: np.ndarray
    last: np.ndarray

    def drawn(self, learner: CellTrees, k: int) -> np.ndarray:
        """Weight of each cell in tree ``k``: a Poisson number for each row of a forest's draw, a share of the rows for boosting."""
        if learner.kind == "tree":
            return self.n.astype(float)
        parts, at = [np.zeros(0)], 0
        for bucket, count in self.buckets:
            rng, n = np.random.default_rng([learner.seed, k, bucket]), self.n[at:at + count]
            parts.append(rng.poisson(n) if learner.kind == "forest" else rng.binomial(n, learner.subsample))
            at += count
        return np.concatenate(parts)

    def placed(self, by_kind: np.ndarray, special: dict[int, np.ndarray]) -> np.ndarray:
        """A value per cell from its combination; ``special`` wide levels have values of their own."""
        found = by_kind[self.kind]
        for own, values in special.items():
            cells = slice(self.first[own], self.last[own])
            found[cells] = values[self.kind[cells]]
        return found


def _packed(kinds: np.ndarray, wide: int | None, targets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    narrow = [f for f in range(len(kinds) + (wide is not None)) if f != wide]
    place = {tuple(k): i for i, k in enumerate(kinds.T.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        names, owner = np.empty(0, object), np.zeros(table.num_rows, np.int32)
        if wide is not None:
            text = table.column(f"code_{wide}").combine_chunks().dictionary_encode()
            found = np.array(text.dictionary.to_pylist(), object)
            order, back = np.argsort(found), np.empty(len(found), np.int32)
            back[order] = np.arange(len(found))
            names, owner = found[order], back[text.indices.to_numpy()]
        kind = np.fromiter((place[k] for k in zip(*[table.column(f"code_{f}").to_pylist() for f in narrow])), np.int32, table.num_rows) if narrow else np.zeros(table.num_rows, np.int32)
        bucket = table.column("bucket").to_numpy()
        order = np.lexsort((kind, owner, bucket))
        owner, bucket = owner[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        first, last = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        if len(names):
            first[owner[starts]], last[owner[starts]] = starts, np.r_[starts[1:], len(owner)]
        share = Share(names, owner, kind[order], table.column("n").to_numpy()[order], [table.column(f"mean_{i}").to_numpy()[order] for i in range(targets)],
                      [(int(b), int(k)) for b, k in zip(*np.unique(bucket, return_counts=True))], first, last)
        yield pa.record_batch({"share": pa.array([pickle.dumps(share, 5)], pa.binary())})
    return run


def _shared(table: DataFrame, kinds: np.ndarray, wide: int | None, targets: int) -> RDD:
    tasks = max(1, min(table.sparkSession.sparkContext.defaultParallelism, BUCKETS))
    dealt = table.repartitionById(tasks, (F.col("bucket") % tasks).cast("int"))
    return dealt.mapInArrow(_packed(kinds, wide, targets), "share binary").rdd.map(lambda r: bytes(r["share"])).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Growing:
    """One tree of one target: node of each combination, those of the wide levels that split it, node totals and the splits so far."""

    node: np.ndarray
    special: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    whole: np.ndarray | None = None
    parts: list = field(default_factory=list)


def _own(special: dict[tuple[int, int], np.ndarray], part: int) -> dict[int, np.ndarray]:
    return {own: values for (p, own), values in special.items() if p == part}


def _level_sums(learner: CellTrees, batch: dict[int, list[Growing]], base: object, kinds: np.ndarray, sizes: list[int], wide: bool, nodes: int) -> Callable:
    """Of each tree and target: sums per node and narrow code, and the best wide level of each node."""
    def run(part: int, shares: Iterator[bytes]) -> Iterator[tuple]:
        for packed in shares:
            share, out = pickle.loads(packed), {}
            predicted = [share.placed(table, _own(special, part)) for table, special in base.value]
            for k, targets in batch.items():
                w = share.drawn(learner, k)
                for i, tree in enumerate(targets):
                    g = w * (share.means[i] - predicted[i])
                    node = share.placed(tree.node, _own(tree.special, part))
                    out[k, i] = (_narrow_sums(node * kinds.shape[1] + share.kind, nodes, w, g, kinds, sizes),
                                 _best_wide(share, part, node, nodes, w, g, tree.whole) if wide and tree.whole is not None else None)
            yield part, out
    return run


def _narrow_sums(at: np.ndarray, nodes: int, w: np.ndarray, g: np.ndarray, kinds: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Weights and residuals per node and narrow code, side by side; the last column is the node's total."""
    count = kinds.shape[1]
    each = np.stack([np.bincount(at, v, nodes * count).reshape(nodes, count) for v in (w, g)])
    node = np.repeat(np.arange(nodes), count)
    parts = [np.stack([np.bincount(node * size + np.tile(row, nodes), v.ravel(), nodes * size).reshape(nodes, size) for v in each]) for row, size in zip(kinds, sizes)]
    return np.concatenate([*parts, each.sum(axis=2, keepdims=True)], axis=2)


def _best_wide(share: Share, part: int, node: np.ndarray, nodes: int, w: np.ndarray, g: np.ndarray, whole: np.ndarray) -> list[tuple]:
    """Gain, name, place and sums of this partition's best wide level of each node."""
    size = len(share.names)
    at = node * size + share.owner
    wl, gl = (np.bincount(at, v, nodes * size).reshape(nodes, size) for v in (w, g))
    top, gain = best_codes(wl, gl, whole[0][:, None], whole[1][:, None], False)
    return [(gain[j], share.names[t], (part, int(t)), wl[j, t], gl[j, t]) for j, t in enumerate(top)]


def _split(tree: Growing, sums: np.ndarray, wide: list[list[tuple]], cells: SpreadCells, sizes: list[int]) -> None:
    """Choose the splits of one level and move combinations and special levels to their new nodes."""
    nodes, narrow = sums.shape[1], [f for f in range(len(cells.ordered)) if f != cells.wide]
    starts, spots = np.concatenate([[0], np.cumsum(sizes)]).astype(int), np.arange(nodes)
    feature, code, best, owner = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, 1e-9), [None] * nodes
    left = sums[:, :, -1].copy()
    for f in range(len(cells.ordered)):
        if f == cells.wide:
            gain, found = np.zeros(nodes), [None] * nodes
            for j in range(nodes):
                gain[j] = max((p[j][0] for p in wide), default=0.0)
                # Of gains within a hair the first name.
                found[j] = min((p[j] for p in wide if p[j][0] >= gain[j] * (1 - HAIR)), key=lambda v: v[1], default=None)
            top, side = np.zeros(nodes, np.int64), np.array([[v[3], v[4]] if v else [0.0, 0.0] for v in found]).T
        else:
            at = narrow.index(f)
            part = sums[:, :, starts[at]:starts[at + 1]]
            top, gain = best_codes(*part, *part.sum(axis=2, keepdims=True), cells.ordered[f])
            side = (part.cumsum(axis=2) if cells.ordered[f] else part)[:, spots, top]
        better = gain > best * (1 + HAIR)
        feature[better], code[better], best[better] = f, top[better], gain[better]
        left[:, better] = side[:, better]
        owner = [(found[j] if f == cells.wide else None) if better[j] else owner[j] for j in range(nodes)]
    whole = sums[:, :, -1]
    tree.whole = np.stack([left, whole - left], axis=2).reshape(2, 2 * nodes)
    tree.parts.append((feature, code, [o and o[1] for o in owner], np.where(feature >= 0, best, 0.0)))
    for o in owner:
        if o and o[2] not in tree.special:
            tree.special[o[2]] = tree.node.copy()
    # Any combination goes right where a wide level splits; the level itself goes left.
    place = np.array([narrow.index(f) if f in narrow else -1 for f in range(len(cells.ordered))])
    at_wide = feature == (-2 if cells.wide is None else cells.wide)
    plain = np.where((feature < 0) | at_wide, -1, place[feature])
    own = [o and o[2] for o in owner]

    def moved(node: np.ndarray, level: tuple | None) -> np.ndarray:
        right = goes_right(cells.kinds, cells.ordered[narrow], plain[node], code[node]) if narrow else np.zeros(len(node), bool)
        stays = np.array([level is not None and o == level for o in own])
        return 2 * node + np.where(at_wide[node], ~stays[node], right)

    tree.special = {level: moved(node, level) for level, node in tree.special.items()}
    tree.node = moved(tree.node, None)


def _batch(cells: SpreadCells, learner: CellTrees, numbers: Sequence[int], targets: int, base: object, sizes: list[int]) -> dict[int, list[Growing]]:
    """The trees of some draws, grown level by level: one job for the totals, one a level."""
    kinds = cells.kinds
    grown = {k: [Growing(np.zeros(kinds.shape[1], np.int64)) for _ in range(targets)] for k in numbers}
    for level in range(-1 if cells.wide is not None else 0, learner.depth):
        nodes = 1 << max(level, 0)
        found = cells.shares.mapPartitionsWithIndex(_level_sums(learner, grown, base, kinds, sizes, cells.wide is not None, nodes)).collect()
        found = [out for _, out in sorted(found, key=lambda f: f[0])]
        for k, trees in grown.items():
            for i, tree in enumerate(trees):
                sums = sum(out[k, i][0] for out in found)
                if level < 0:
                    tree.whole = sums[:, :, -1]
                else:
                    _split(tree, sums, [out[k, i][1] for out in found if out[k, i][1]], cells, sizes)
    return grown


def fit_spread(cells: SpreadCells, learner: CellTrees, targets: Sequence[str]) -> list[CellModel]:
    """One model a target, all grown beside each other."""
    spark, kinds = cells.table.sparkSession, cells.kinds.shape[1]
    means = cells.table.agg(*[(F.sum(F.col("n") * F.col(f"mean_{cells.targets.index(t)}")) / F.sum("n")).alias(f"m{i}") for i, t in enumerate(targets)]).first()
    boosting, count = learner.kind == "boosting", 1 if learner.kind == "tree" else learner.trees
    starts = [float(means[f"m{i}"]) for i in range(len(targets))]
    sizes = [len(e) + int(o) for f, (e, o) in enumerate(zip(cells.edges, cells.ordered)) if f != cells.wide]
    base = [(np.full(kinds, s if boosting else 0.0), {}) for s in starts]
    models: list[list[tuple]] = [[] for _ in targets]
    step = 1 if boosting else BATCH
    # Targets keep their places in the shares; those not asked for stay out of the sums.
    order = [cells.targets.index(t) for t in targets]
    for begin in range(0, count, step):
        sent = spark.sparkContext.broadcast([base[order.index(i)] if i in order else (np.zeros(kinds), {}) for i in range(len(cells.targets))])
        grown = _batch(cells, learner, range(begin, min(begin + step, count)), len(cells.targets), sent, sizes)
        sent.unpersist()
        for k in sorted(grown):
            for place, i in enumerate(order):
                tree = grown[k][i]
                weight, total = tree.whole
                leaf = np.divide(total, weight, out=np.zeros(1 << learner.depth), where=weight > 0.5)
                models[place].append((*(sum((list(p[j]) for p in tree.parts), []) for j in range(4)), leaf))
                if boosting:
                    table, special = base[place]
                    own = {level: special.get(level, table) for level in {*special, *tree.special}}
                    own = {level: values + learner.step * leaf[tree.special.get(level, tree.node)] for level, values in own.items()}
                    base[place] = (table + learner.step * leaf[tree.node], own)
    return [_model(cells, learner, starts[i], rows) for i, rows in enumerate(models)]


def _model(cells: SpreadCells, learner: CellTrees, start: float, rows: list[tuple]) -> CellModel:
    """Of the wide column only the levels that split something get a code; all others are like no level."""
    edges = list(cells.edges)
    names = sorted({v for r in rows for v in r[2] if v is not None})
    if cells.wide is not None:
        edges[cells.wide] = names
    place = {v: i for i, v in enumerate(names)}
    trees = [Tree(np.array(f), np.array([at if v is None else place[v] for at, v in zip(code, name)]), np.array(gain), leaf) for f, code, name, gain, leaf in rows]
    start, step = (start, learner.step) if learner.kind == "boosting" else (0.0, 1 / len(trees))
    return CellModel(start, step, trees, cells.columns, edges, cells.ordered)
