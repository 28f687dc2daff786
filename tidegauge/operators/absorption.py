"""Least squares with several wide label columns: their effects are solved by conjugate gradients over sums per level.

The normal equations of label columns need no matrix: multiplying by it sends each level's value to the
combinations of levels that hold it and sums what comes back. The first column, the widest, is eliminated exactly, as its own
block is diagonal, so that only the other columns' levels are iterated and half as many steps are needed. Combinations lie
in blocks of arrays (``level_blocks``): a step moves numbers alone; the driver sees a few sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.cluster import connected_components
from tidegauge.operators.level_blocks import MESSAGE, Blocks, laid_out, met, opened, rows_out, unframed
from tidegauge.plans.sizing import checkpointed

#: Steps end when every right-hand side has this share of its first norm left.
CLOSE = 1e-9
MOST_STEPS = 300
#: Rounds in which levels take the lowest number near them before what still differs is joined as links.
NEAR = 4


class NotConverged(ArithmeticError):
    pass


@dataclass(frozen=True)
class Absorbed:
    """What the wide columns explain: products of the vectors' sums with their effects, the effects per level, and the rank.

    ``alone`` has products and levels of each column by itself, ``lowest`` each column's first level with its effects.
    """

    products: np.ndarray
    effects: DataFrame
    rank: int
    alone: dict[str, Absorbed] = field(default_factory=dict)
    lowest: list[tuple[str, np.ndarray]] = field(default_factory=list)


def _vector_sum(name: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(name, i)) for i in range(size)])


def _written(state: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``state`` in the checkpoint folder, and the blocks' sums added up."""
    done = checkpointed(state)
    return done, np.sum([r["sums"] for r in done.select("sums").collect()], axis=0)


def _scaled(factors: np.ndarray, vector: Column | str, divided: bool = False) -> Column:
    items = []
    for k, f in enumerate(factors):
        value = F.lit(float(f)) * F.get(vector, k)
        items.append(value / F.col("d") if divided else value)
    return F.array(*items)


def lone_effects(cells: DataFrame, column: str, size: int) -> DataFrame:
    """(axis, level, b, x) of one label column: its effects are means."""
    found = cells.groupBy(F.col(column).alias("level")).agg(F.sum("n").cast("double").alias("d"), _vector_sum("s", size).alias("b"))
    return found.select(F.lit(0).alias("axis"), "level", "b", _scaled(np.ones(size), "b", divided=True).alias("x"))


def _after(step: np.ndarray, more: np.ndarray):
    """The state (x, r, p, q) behind a step of that length, with the direction of the next."""
    def run(d: np.ndarray, state: np.ndarray) -> np.ndarray:
        x, r, p, q = state = state.reshape(4, len(step), -1).copy()
        x += step[:, None] * p
        r -= step[:, None] * q
        p *= more[:, None]
        p += r / d
        return state
    return run


def _residuals(values: np.ndarray, places: np.ndarray, n: np.ndarray, begins: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The matrix of level products, without what the own levels explain, times the values, as far as these cells go."""
    found = np.zeros_like(values)
    weight = np.add.reduceat(n, begins) if len(n) else held
    for k, value in enumerate(values):
        v = _placed(value, places, n)
        v -= np.repeat(np.add.reduceat(v, begins) / weight, held) * (n if len(n) else 1.0)
        for at in places:
            found[k] += np.bincount(at, v, len(value))
    return found


def _placed(value: np.ndarray, places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the levels' values add up to in the cells' rows."""
    v = value[places[0]]
    for at in places[1:]:
        v += value[at]
    if len(n):
        v *= n
    return v


def _multiplied(size: int, after):
    """The state with q and sums of products over the levels: r r / d, p q, r q / d, q q / d."""
    def run(block: int, d: np.ndarray, state: np.ndarray, answers) -> tuple[np.ndarray, list[float]]:
        state = after(d, state)
        _, r, p, q = state
        q[:] = 0.0
        for at, values in answers:
            q[:, at] += values
        return state, np.concatenate([(r * r / d).sum(axis=1), (p * q).sum(axis=1), (r * q / d).sum(axis=1), (q * q / d).sum(axis=1)]).tolist()
    return run


def _own_parts(cells: pa.Table, came: pa.Table) -> pa.Table:
    """What the other levels' effects add up to in each own level."""
    values, places, n, begins, _, _ = opened(cells, came)
    found = np.stack([np.add.reduceat(_placed(value, places, n), begins) for value in values])
    return rows_out([(cells["block"][0].as_py(), 0, found.tobytes(), None)])


def _effect_tables(names: pa.Table, found: np.ndarray, size: int, own: bool) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """Names, sums and effects of a block's levels, column by column."""
    count = 0
    for a, data in sorted(zip(names["at"].to_pylist(), names["data"]), key=lambda x: x[0]):
        table = unframed(data)
        sums = np.stack([table[f"s{k}"].to_numpy() for k in range(size)])
        part = found[:, count : count + table.num_rows]
        count += table.num_rows
        yield (0 if own else a + 1), table, sums, (sums - part) / table["n"].to_numpy() if own else part


def _effects(size: int, own: bool, state):
    def run(names: pa.Table, came: pa.Table) -> pa.Table:
        out = []
        for axis, table, b, x in _effect_tables(names, state(names, came), size, own):
            ends = pa.array(np.arange(0, size * (table.num_rows + 1), size, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.T.ravel())) for v in (b, x)]
            out.append(pa.table({"axis": pa.array(np.full(table.num_rows, axis, np.int32)), "level": table["level"], "b": lists[0], "x": lists[1]}))
        return pa.concat_tables(out)
    return run


def _ends(size: int, own: bool, state):
    """Per column of a block: products of sums and effects, and the lowest level with its effects."""
    def run(names: pa.Table, came: pa.Table) -> pa.Table:
        out = []
        for axis, table, b, x in _effect_tables(names, state(names, came), size, own):
            low = pc.min(table["level"])
            out.append({"axis": axis, "low": low.as_py(), "sums": (b @ x.T).ravel(), "at_low": x[:, pc.index(table["level"], low).as_py()]})
        return pa.Table.from_pylist(out, schema=pa.schema([("axis", pa.int32()), ("low", pa.string()), ("sums", pa.list_(pa.float64())), ("at_low", pa.list_(pa.float64()))]))
    return run


def level_effects(blocks: Blocks) -> tuple[DataFrame, np.ndarray, list[tuple[str, np.ndarray]]]:
    """(axis, level, b, x): sums of the vectors per level and the effects that reproduce them; products of both; each column's lowest level.

    Jacobi-preconditioned conjugate gradients, all right-hand sides at once. The system may be singular, since effects can move
    between columns; its solution's products are unique. State is written to the checkpoint folder once a step.
    """
    size, none = blocks.size, np.zeros(blocks.size)
    state, sums = _written(blocks.start)
    (left, whole), after = sums.reshape(2, size), _after(none, none)
    own = np.sum([r["sums"] for r in blocks.own.select("sums").collect()], axis=0)[1:].reshape(size, size)
    first, after = whole + np.diag(own), lambda d, state: state.reshape(4, size, -1).copy()
    for _ in range(MOST_STEPS):
        if (left <= CLOSE**2 * first).all():
            return _solved(blocks, state, after)
        # Sums of the residual as it is now, so that rounding of earlier steps doesn't stay.
        give = lambda block, d, state, after=after: after(d, state)[2]
        state, sums = _written(blocks.told(state, give, _residuals, _multiplied(size, after)))
        left, pq, rq, qq = sums.reshape(4, size)
        step = np.divide(left, pq, out=none.copy(), where=(pq > 0) & (left > CLOSE**2 * first))
        # The residual's next norm from sums at hand saves a pass; rounding can't take it below zero.
        ahead = np.maximum(left - 2 * step * rq + step * step * qq, 0.0)
        more = np.divide(ahead, left, out=none.copy(), where=(left > 0) & (step > 0))
        left, after = ahead, _after(step, more)
    raise NotConverged(f"effects of {blocks.axes + 1} label columns are not settled after {MOST_STEPS} steps")


def _solved(blocks: Blocks, state: DataFrame, after) -> tuple[DataFrame, np.ndarray, list[tuple[str, np.ndarray]]]:
    size = blocks.size
    own = checkpointed(blocks.asked(state, lambda block, d, state: after(d, state)[0], _own_parts))
    # The divisor isn't needed for x.
    sides = [(blocks.own, own, True, lambda names, came: np.frombuffer(came["data"][0].as_buffer()).reshape(size, -1)),
             (blocks.rest, state, False, lambda names, came: after(1.0, np.frombuffer(came["data"][0].as_buffer()))[0])]
    effects, ends = [], []
    for names, found, is_own, read in sides:
        effects.append(met(names, found, _effects(size, is_own, read), "axis int, level string, b array<double>, x array<double>"))
        ends += met(names, found, _ends(size, is_own, read), "axis int, low string, sums array<double>, at_low array<double>").collect()
    lows = [min((r for r in ends if r["axis"] == a), key=lambda r: r["low"].encode()) for a in range(blocks.axes + 1)]
    products = np.sum([r["sums"] for r in ends], axis=0).reshape(size, size)
    return effects[0].union(effects[1]), products, [(r["low"], np.array(r["at_low"])) for r in lows]


def vectors_of(column: pa.ListArray, rows: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            b, x = (vectors_of(batch.column(k), batch.num_rows) for k in ("b", "x"))
            total = b.T @ x if total is None else total + b.T @ x
    if total is not None:
        yield pa.record_batch({"sums": pa.array([total.tobytes()], pa.binary())})


def _numbered(block: int, d: np.ndarray, state: np.ndarray) -> np.ndarray:
    return ((block << 32) + np.arange(len(d), dtype=np.int64))[None]


def _labels(block: int, d: np.ndarray, state: np.ndarray) -> np.ndarray:
    return state.view(np.int64)[None]


def _lowest(values: np.ndarray, places: np.ndarray, n: np.ndarray, begins: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Each level's lowest label among the levels of its column that share an own level with it."""
    found = values.view(np.int64)[0].copy()
    for at in places:
        np.minimum.at(found, at, np.repeat(np.minimum.reduceat(values.view(np.int64)[0][at], begins), held))
    return found[None]


def _lower(before):
    def run(block: int, d: np.ndarray, state: np.ndarray, answers) -> tuple[np.ndarray, list[float]]:
        found = before(block, d, state)[0].copy()
        for at, values in answers:
            found[at] = np.minimum(found[at], values.view(np.int64)[0])
        return found, []
    return run


def _links(cells: pa.Table, came: pa.Table) -> pa.Table:
    """Labels that an own level holds beside a lower one."""
    values, places, _, begins, held, _ = opened(cells, came)
    labels, found = values.view(np.int64)[0], []
    for at in places:
        first, here = np.repeat(np.minimum.reduceat(labels[at], begins), held), labels[at]
        found.append(np.stack([first[first < here], here[first < here]]))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.table({"a": a, "b": b})


def _held(routes: pa.Table, state: pa.Table) -> pa.Table:
    return pa.table({"label": np.unique(np.frombuffer(state["data"][0].as_buffer(), np.int64))})


def unlinked(blocks: Blocks) -> int:
    """Groups of levels that no row connects, of the first column and each other one, added up.

    Levels take the lowest label of those they share an own level with, a few times over. Labels that still meet in an own level are links between them; components are taken of these alone.
    """
    state, give = blocks.start, _numbered
    for _ in range(NEAR):
        state, give = checkpointed(blocks.told(state, give, _lowest, _lower(give))), _labels
    links = blocks.asked(state, _labels, _links, "a bigint, b bigint").distinct()
    links = checkpointed(links.select(F.lit(0).alias("run"), "a", "b"))
    labels = met(blocks.routes, state, _held, "label bigint").distinct().count()
    if not links.take(1):
        return labels
    edges = links.union(links.select("run", "b", "a"))
    found = connected_components(edges.select("run", F.col("a").alias("id")).distinct(), edges).agg(F.count("*").alias("n"), F.count_distinct("label").alias("groups")).first()
    return labels - found["n"] + found["groups"]


def linked_groups(by_own: DataFrame, by_rest: DataFrame, own: str, other: str) -> int:
    """Groups of levels of two columns that no row connects."""
    with laid_out(by_own, [own, other], []) as blocks:
        return unlinked(blocks)


def wide_rank(cells: DataFrame, wide: Sequence[str], blocks: Blocks | None = None) -> int:
    """Rank of the label columns together, the constant included.

    Of two columns: their levels less the groups of levels that no row connects. Each further column is counted against the first alone, the
    usual bound.
    """
    if blocks is None:
        with laid_out(cells, wide, []) as found:
            return wide_rank(cells, wide, found)
    return sum(int(a.rank) for a in _alone(blocks, wide).values()) - unlinked(blocks)


def _alone(blocks: Blocks, wide: Sequence[str]) -> dict[str, Absorbed]:
    """Products and levels of each column by itself."""
    size, found = blocks.size, {}
    parts = [(0, r["sums"]) for r in blocks.own.select("sums").collect()] + [(r["at"] + 1, r["sums"]) for r in blocks.rest.select("at", "sums").collect()]
    for i, w in enumerate(wide):
        total = np.sum([s for a, s in parts if a == i], axis=0)
        found[w] = Absorbed(total[1:].reshape(size, size), None, int(total[0]))
    return found


def absorb(rows: DataFrame, wide: Sequence[str], vectors: Sequence[Column]) -> Absorbed:
    """Project ``vectors`` of the rows on the label columns ``wide``, the widest first."""
    named, size = [v.alias(f"v{k}") for k, v in enumerate(vectors)], len(vectors)
    if len(wide) == 1:
        keyed = rows.select(*wide, *named).groupBy(*wide)
        cells = keyed.agg(F.count("*").alias("n"), F.array(*[F.sum(f"v{k}") for k in range(size)]).alias("s"))
        effects = checkpointed(lone_effects(cells, wide[0], size))
        parts = [np.frombuffer(r["sums"]) for r in effects.select("b", "x").coalesce(16).mapInArrow(_outer, "sums binary").collect()]
        return Absorbed(sum(parts, np.zeros(size**2)).reshape(size, size), effects, effects.count())
    with laid_out(rows.select(*wide, *named), wide, [f"v{k}" for k in range(size)]) as blocks:
        effects, products, lowest = level_effects(blocks)
        return Absorbed(products, effects, wide_rank(rows, wide, blocks), _alone(blocks, wide), lowest)


def without_each(wide: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Each column and the others."""
    return [(w, list(rest)) for w, rest in zip(reversed(wide), itertools.combinations(wide, len(wide) - 1))]
