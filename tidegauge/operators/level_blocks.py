"""Rows of label columns as blocks of arrays, so that sums move between levels without keys.

Rows are dealt by the level of the first column, ``own``; a block holds its cells (rows of the same levels together) as places among the levels that
occur in it. Levels of the other columns are dealt by hash to blocks of their own. Either side knows the order of what the other
sends: a step moves one array for each pair of blocks, numbers alone. Blocks are written to the checkpoint folder when they are made, since
a block made again might put its levels in another order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans.sizing import shared_path

#: Numbers per task: rows of a block times the vectors, and rows packed together before the shuffle.
BLOCK_NUMBERS, LEAST_ROWS, PACKED_ROWS = 2**21, 2**16, 2**18
MESSAGE = "block int, at int, data binary, sums array<double>"
_FIELDS = pa.schema([("block", pa.int32()), ("at", pa.int32()), ("data", pa.binary()), ("sums", pa.list_(pa.float64()))])
_KINDS = pa.schema([("kind", pa.string()), *_FIELDS])

Give = Callable[[int, np.ndarray, np.ndarray], np.ndarray]
Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Take = Callable[[int, np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]], tuple[np.ndarray, list[float]]]


@dataclass(frozen=True)
class Blocks:
    """``cells``: a block's cells. ``routes``: for a block of levels, which of them each block of cells holds. ``own`` and ``rest``:
    names and sums of the levels. ``start``: the levels' sums and what is left of them when ``own`` has explained its part."""

    keys: np.ndarray
    axes: int
    size: int
    cells: DataFrame
    routes: DataFrame
    own: DataFrame
    rest: DataFrame
    start: DataFrame

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.cells.unpersist()
        self.routes.unpersist()

    def asked(self, state: DataFrame, give: Give, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str = MESSAGE) -> DataFrame:
        """What ``step`` finds in each block of cells with its levels' columns of what ``give`` makes of the levels' rows and state."""
        return met(self.cells, met(self.routes, state, _give(self.keys, give)), step, schema)

    def told(self, state: DataFrame, give: Give, work: Work, take: Take) -> DataFrame:
        """The next state: ``work`` answers from the cells, ``take`` joins the answers with the state."""
        back = self.asked(state, give, _work(self.keys, work))
        return met(self.routes, back.union(state.withColumn("at", F.lit(-1))), _take(take))


def met(still: DataFrame, moving: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str = MESSAGE) -> DataFrame:
    """Rows of a block with what came for it; ``still`` stays where it is."""
    return still.groupBy("block").cogroup(moving.groupBy("block")).applyInArrow(step, schema)


def bundled(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each begun at a multiple of eight."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), a.size)]], np.int64)
    return b"".join([head.tobytes(), *[a.tobytes() + bytes(-a.nbytes % 8) for a in map(np.ascontiguousarray, arrays)]])


def unbundled(data: pa.Scalar) -> list[np.ndarray]:
    buffer = data.as_buffer()
    count = int(np.frombuffer(buffer, np.int64, 1)[0])
    head, at, found = np.frombuffer(buffer, np.int64, 1 + 2 * count)[1:], 8 * (1 + 2 * count), []
    for kind, size in head.reshape(count, 2):
        found.append(np.frombuffer(buffer, np.dtype(chr(kind)), size, at))
        at += -(-found[-1].nbytes // 8) * 8
    return found


def framed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unframed(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def rows_out(rows: Sequence[tuple], schema: pa.Schema = _FIELDS) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def block_keys(spark: SparkSession, count: int) -> np.ndarray:
    """A number for each block that a shuffle over as many partitions deals to one of its own."""
    number = F.col("id").cast("int")
    found = spark.range(40 * count + 100).select(number.alias("key"), F.pmod(F.hash(number), F.lit(count)).alias("at")).groupBy("at").agg(F.min("key").alias("key")).collect()
    at = {r["at"]: r["key"] for r in found}
    return np.array([at.get(i, -1 - i) for i in range(count)], np.int32)


def stored(df: DataFrame) -> Callable[[str], DataFrame]:
    """Written once, a folder per kind; a table of each, read by itself, since tables of one plan don't meet in a cogroup."""
    path = shared_path(df.sparkSession, "blocks")
    df.write.partitionBy("kind").parquet(path)
    return lambda kind: df.sparkSession.read.schema(df.schema).parquet(path).filter(F.col("kind") == kind).select("block", "at", "data", "sums")


def laid_out(rows: DataFrame, wide: Sequence[str], vectors: Sequence[str], count: int | None = None) -> Blocks:
    """Blocks of the rows by the levels of ``wide``, the first column's in its own order, with the sums of ``vectors``."""
    spark, size, axes = rows.sparkSession, len(vectors), len(wide) - 1
    count = rows.count() if count is None else count
    cores, least = spark.sparkContext.defaultParallelism, -(-count * max(size, 2) // BLOCK_NUMBERS)
    parts = max(1, min(cores, -(-count // LEAST_ROWS)), -(-least // cores) * cores if least > 1 else 1)
    keys = block_keys(spark, parts)
    dealt = [F.pmod(F.xxhash64(w), F.lit(parts)).cast("int").alias(f"t{i}") for i, w in enumerate(wide)]
    flat = rows.select(*dealt, F.xxhash64(*wide).alias("h"), *[F.col(w).alias(f"w{i}") for i, w in enumerate(wide)], *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(vectors)])
    moved = flat.mapInArrow(_packed(keys, axes, size), "block int, data binary").repartition(parts, "block")
    made = stored(moved.groupBy("block").applyInArrow(_cells(keys, axes, size), f"kind string, {MESSAGE}"))
    levels = made("level").repartition(parts, "block").groupBy("block").applyInArrow(_levels(keys, axes, size), f"kind string, {MESSAGE}")
    told = stored(levels)

    def kept(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "block").persist()

    return Blocks(keys, axes, size, kept(made("cells")), kept(told("routes")), made("own"), told("rest"), told("state"))


def _codes(columns: Sequence[pa.ChunkedArray]) -> tuple[list[np.ndarray], list[pa.Array]]:
    found = [c.combine_chunks().dictionary_encode() for c in columns]
    return [f.indices.to_numpy(zero_copy_only=False).astype(np.int64) for f in found], [f.dictionary for f in found]


def _joint(codes: Sequence[np.ndarray], levels: Sequence[pa.Array]) -> np.ndarray:
    """One number per row for its levels together, ordered by the first."""
    key, span = codes[0], len(levels[0])
    for c, found in zip(codes[1:], levels[1:]):
        if span * len(found) >= 2**62:
            distinct, key = np.unique(key, return_inverse=True)
            span = len(distinct)
        key, span = key * len(found) + c, span * len(found)
    return key


def _packed(keys: np.ndarray, axes: int, size: int):
    """Rows of a task by the block of their own level; rows of the same levels are summed before they move."""
    names = [*[f"t{i}" for i in range(1, axes + 1)], *[f"w{i}" for i in range(axes + 1)]]

    def sent(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        held, numbers = table.num_rows, {f"v{k}": table[f"v{k}"].to_numpy() for k in range(size)}
        if np.count_nonzero(np.diff(np.sort(table["h"].to_numpy()))) + 1 < 0.8 * held:
            _, first, inverse = np.unique(_joint(*_codes([table[f"w{i}"] for i in range(axes + 1)])), return_index=True, return_inverse=True)
            table = table.take(pa.array(first))
            numbers = {"n": np.bincount(inverse), **{k: np.bincount(inverse, v) for k, v in numbers.items()}}
        else:
            numbers = {"n": np.ones(held, np.int64), **numbers}
        to = table["t0"].to_numpy()
        order = np.argsort(to.astype(np.int16) if len(keys) < 2**15 else to, kind="stable")
        table = pa.table({**{n: table[n] for n in names}, **numbers}).take(pa.array(order)).combine_chunks()
        counts = np.bincount(to, minlength=len(keys))
        ends, some = np.cumsum(counts), np.flatnonzero(counts)
        return pa.record_batch({"block": pa.array(keys[some]), "data": pa.array([framed(table.slice(ends[b] - counts[b], counts[b])) for b in some], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows * max(size, 2) >= 2 * PACKED_ROWS:
                yield sent(held)
                held, rows = [], 0
        if rows:
            yield sent(held)
    return run


def _cells(keys: np.ndarray, axes: int, size: int):
    """A block of cells from its rows: the cells, names and sums of its own levels, and sums of the other levels for their blocks."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([unframed(x) for x in table["data"]])
        at = key[0].as_py()
        block = _place(keys, at)
        codes, levels = _codes([rows[f"w{i}"] for i in range(axes + 1)])
        to = np.concatenate([_firsts(codes[a], rows[f"t{a}"].to_numpy(), len(levels[a])) for a in range(1, axes + 1)])
        joint = _joint(codes, levels)
        order = np.argsort(joint)
        starts = np.flatnonzero(np.diff(joint[order], prepend=-1))
        n, *sums = [np.add.reduceat(rows[v].to_numpy()[order], starts) for v in ("n", *[f"v{k}" for k in range(size)])]
        codes = [c[order[starts]] for c in codes]
        # Levels of the other columns stand in the order of their blocks.
        by = np.argsort(to, kind="stable")
        place = np.empty(len(to), np.int64)
        place[by] = np.arange(len(to))
        ends = np.cumsum([0, *[len(x) for x in levels[1:]]])
        cells = np.stack([place[ends[a] + c] for a, c in enumerate(codes[1:])])
        begins = np.flatnonzero(np.diff(codes[0], prepend=-1))
        held = np.diff(begins, append=len(codes[0]))
        rows_of, of = np.add.reduceat(n, begins), [np.add.reduceat(s, begins) for s in sums]
        kept = [s - np.repeat(o / rows_of, held) * n for s, o in zip(sums, of)]
        per = [np.sum([np.bincount(c, v, len(to)) for c in cells], axis=0) for v in (n, *sums, *kept)]
        named, axis, counts = pa.concat_arrays(levels[1:]).take(pa.array(by)), np.repeat(np.arange(axes), np.diff(ends))[by], np.bincount(to, minlength=len(keys))
        explained = [float(np.dot(a, b / rows_of)) for a in of for b in of]
        alone = bundled(counts.astype(np.int32), held.astype(np.int32), cells.astype(np.int32).ravel(), n[:0] if (n == 1).all() else n.astype(float))
        own = framed(pa.table({"level": levels[0].take(pa.array(codes[0][begins])), "n": rows_of.astype(float), **{f"s{k}": o for k, o in enumerate(of)}}))
        out = [("cells", at, block, alone, None), ("own", at, 0, own, [float(len(begins)), *explained])]
        everything = pa.table({"axis": axis, "level": named, **{f"p{k}": v for k, v in enumerate(per)}})
        last = np.cumsum(counts)
        out += [("level", int(keys[r]), block, framed(everything.slice(last[r] - counts[r], counts[r])), None) for r in np.flatnonzero(counts)]
        return rows_out(out, _KINDS)
    return run


def _place(keys: np.ndarray, key: int) -> int:
    return int(np.flatnonzero(keys == key)[0])


def _firsts(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    found = np.empty(size, np.int64)
    found[codes] = values
    return found


def _levels(keys: np.ndarray, axes: int, size: int):
    """A block of levels from what the blocks of cells hold of them: the routes, names and sums, and the state to start from."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        at, order = key[0].as_py(), np.argsort(table["at"].to_numpy())
        parts = [unframed(table["data"][int(i)]) for i in order]
        rows = pa.concat_tables(parts)
        axis, idx, names, count = rows["axis"].to_numpy(), np.empty(rows.num_rows, np.int32), [], 0
        for a in range(axes):
            mine = np.flatnonzero(axis == a)
            (codes,), (levels,) = _codes([rows["level"].take(pa.array(mine))])
            idx[mine] = codes + count
            names.append((count, count + len(levels), levels))
            count += len(levels)
        per = [np.bincount(idx, rows[f"p{k}"].to_numpy(), count) for k in range(1 + 2 * size)]
        d, sums, left = per[0], per[1 : 1 + size], per[1 + size :]
        out = [("routes", at, _place(keys, at), bundled(table["at"].to_numpy()[order], np.array([p.num_rows for p in parts], np.int32), idx, d), None)]
        for a, (low, high, levels) in enumerate(names):
            if high > low:
                of, rows_of = [s[low:high] for s in sums], d[low:high]
                explained = [float(np.dot(x, y / rows_of)) for x in of for y in of]
                out.append(("rest", at, a, framed(pa.table({"level": levels, "n": rows_of, **{f"s{k}": o for k, o in enumerate(of)}})), [float(high - low), *explained]))
        none = np.zeros((size, count))
        state = np.stack([none, left, np.array(left) / d, none]) if size else np.zeros(count)
        norms = [float(np.sum(v * v / d)) for v in (*left, *sums)]
        return rows_out([*out, ("state", at, 0, state.tobytes(), norms)], _KINDS)
    return run


def _give(keys: np.ndarray, give):
    def run(routes: pa.Table, state: pa.Table) -> pa.Table:
        froms, lengths, idx, d = unbundled(routes["data"][0])
        block, ends = routes["at"][0].as_py(), np.cumsum(lengths)
        values = give(block, d, np.frombuffer(state["data"][0].as_buffer()))
        return rows_out([(int(keys[b]), block, values[:, idx[e - k : e]].tobytes(), None) for b, k, e in zip(froms, lengths, ends)])
    return run


def opened(cells: pa.Table, came: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block of cells and what came for its levels: values per level, places of each column's levels by cell, rows by cell (none: all one), the
    first cell and the number of cells of each own level, and levels per block."""
    counts, held, places, n = unbundled(cells["data"][0])
    data = {a.as_py(): x.as_buffer() for a, x in zip(came["at"], came["data"])}
    values = np.concatenate([np.frombuffer(data[int(r)]).reshape(-1, counts[r]) for r in np.flatnonzero(counts)], axis=1)
    return values, places.reshape(-1, int(held.sum())), n, np.cumsum(held) - held, held, counts


def _work(keys: np.ndarray, work: Work):
    def run(cells: pa.Table, came: pa.Table) -> pa.Table:
        *given, counts = opened(cells, came)
        found, ends, block = work(*given), np.cumsum(counts), cells["at"][0].as_py()
        return rows_out([(int(keys[r]), block, found[:, ends[r] - counts[r] : ends[r]].tobytes(), None) for r in np.flatnonzero(counts)])
    return run


def _take(take):
    def run(routes: pa.Table, came: pa.Table) -> pa.Table:
        froms, lengths, idx, d = unbundled(routes["data"][0])
        data = {a.as_py(): x.as_buffer() for a, x in zip(came["at"], came["data"])}
        ends = np.cumsum(lengths)
        answers = ((idx[e - k : e], np.frombuffer(data[int(b)]).reshape(-1, k)) for b, k, e in zip(froms, lengths, ends))
        state, sums = take(routes["at"][0].as_py(), d, np.frombuffer(data[-1]), answers)
        return rows_out([(routes["block"][0].as_py(), 0, state.tobytes(), sums)])
    return run
