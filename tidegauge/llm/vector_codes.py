"""Vector codes: parts of integer vectors coded by their nearest codebook entries, found in a GNAT."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, checkpointed, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf, and split points of an inner node.
LEAF, SPLITS = 8, 8
#: Largest magnitude of a component for which squared distances of up to 2^13 components are exact in doubles.
EXACT = 1 << 19
BATCH = 4096
#: Above every index.
NO_ENTRY = 1 << 62


def _floor_root(squares: np.ndarray) -> np.ndarray:
    """Integer square root, rounded down."""
    if squares.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(squares)
    root = np.floor(np.sqrt(squares))
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def _ceil_root(squares: np.ndarray) -> np.ndarray:
    root = _floor_root(squares)
    return root + (root * root < squares)


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; whole numbers below 2^53 in doubles, or Python integers."""
    cross = queries @ points.T
    return (queries * queries).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * cross


def exact_type(*arrays: np.ndarray) -> type:
    """Doubles where they hold every distance exactly, else Python integers."""
    return float if all(not a.size or np.abs(a).max() < EXACT for a in arrays) else object


class Gnat:
    """Geometric near-neighbour access tree (Brin 1995) over codebook entries.

    A node has split points far from each other; every other entry goes to its nearest one. For each split point and
    each subtree the node keeps the range of distances between them. A query that knows its distance
    to a split point leaves out the subtrees that can hold only farther entries than its best so far.
    """

    def __init__(self, points: np.ndarray, index: np.ndarray):
        self.points, self.index, self.children, self.split = points, index, [], 0
        if len(points) <= LEAF:
            return
        chosen = [0]
        nearest = squared(points, points[:1])[:, 0]
        while len(chosen) < SPLITS and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(points, points[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return
        apart = squared(points, points[chosen])
        owner = apart.argmin(axis=1)
        self.split = len(chosen)
        self.split_points, self.split_index = points[chosen], index[chosen]
        low, high = np.empty((self.split, self.split), points.dtype), np.empty((self.split, self.split), points.dtype)
        plain = np.ones(len(points), bool)
        plain[chosen] = False
        for j in range(self.split):
            inside = apart[owner == j]
            low[:, j], high[:, j] = _floor_root(inside.min(axis=0)), _ceil_root(inside.max(axis=0))
            rest = plain & (owner == j)
            self.children.append(Gnat(points[rest], index[rest]) if rest.any() else None)
        self.low, self.high = low, high

    def search(self, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        """Improve ``best`` and ``entry`` of ``rows``; equally near entries go by the lower index."""
        if not len(rows):
            return
        points, index = (self.split_points, self.split_index) if self.split else (self.points, self.index)
        apart = squared(queries[rows], points)
        closest = apart.min(axis=1)
        # Ties are told in integers: the lowest index among the entries at exactly the smallest distance.
        lowest = np.where(apart == closest[:, None], index[None, :], NO_ENTRY).min(axis=1)
        better = (closest < best[rows]) | ((closest == best[rows]) & (lowest < entry[rows]))
        best[rows[better]], entry[rows[better]] = closest[better], lowest[better]
        if not self.split:
            return
        home, near, far = apart.argmin(axis=1), _floor_root(apart), _ceil_root(apart)
        for j, child in enumerate(self.children):
            if child is not None:
                child.search(queries, rows[home == j], best, entry)
        for j, child in enumerate(self.children):
            if child is None:
                continue
            reach = _ceil_root(best[rows])[:, None]
            # Strictly beyond reach, with all roots rounded against leaving out: an equally near entry is never lost.
            beyond = (near - reach > self.high[None, :, j]) | (self.low[None, :, j] - far > reach)
            child.search(queries, rows[(home != j) & ~beyond.any(axis=1)], best, entry)


def nearest_entries(queries: np.ndarray, codebook: np.ndarray, tree: Gnat | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each query and the squared distance, exact; ties go to the lower index."""
    kind = exact_type(queries, codebook)
    if tree is None or tree.points.dtype != kind:
        tree = Gnat(as_type(codebook, kind), np.arange(len(codebook)))
    queries = as_type(queries, kind)
    best, entry = np.full(len(queries), np.inf, kind), np.full(len(queries), NO_ENTRY)
    for start in range(0, len(queries), BATCH):
        tree.search(queries, np.arange(start, min(start + BATCH, len(queries))), best, entry)
    return entry, best


def as_type(whole: np.ndarray, kind: type) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(whole) if kind is object else whole.astype(float)


def _integers(scale: int) -> Callable:
    """Components as whole numbers in doubles: scaling by a power of two and the floor are exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale) + 0.0
            ends = np.cumsum([0, *pa.compute.list_value_length(vectors).to_pylist()])
            packed = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "packed": packed})
    return run


def unpacked(values: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), float).reshape(-1, size)


def _trees(codebooks: list[np.ndarray]) -> list[Gnat]:
    return [Gnat(as_type(book, exact_type(book)), np.arange(len(book))) for book in codebooks]


def _assigned(batch: pa.RecordBatch, codebooks: list[np.ndarray], trees: list[Gnat], size: int) -> Iterator[tuple]:
    vectors = unpacked(batch.column("packed").to_pylist(), size)
    for part, cut in enumerate(np.split(vectors, len(codebooks), axis=1)):
        yield part, cut, *nearest_entries(cut, codebooks[part], trees[part])


def _sums(codebooks: list[np.ndarray], size: int) -> Callable:
    """For each part and entry of a task: how many parts it got, and their component sums in decimal digits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, total = _trees(codebooks), {}
        for batch in batches:
            for part, cut, entry, _ in _assigned(batch, codebooks, trees, size):
                order = np.argsort(entry, kind="stable")
                used, first, n = np.unique(entry[order], return_index=True, return_counts=True)
                # Batches are small enough for sums of exact doubles to be exact.
                sums = np.add.reduceat(as_type(cut[order], exact_type(cut)), first, axis=0) if len(used) else ()
                for e, row, count in zip(used.tolist(), sums, n.tolist()):
                    held = total.setdefault((part, e), [0] * (len(row) + 1))
                    total[part, e] = [a + int(b) for a, b in zip(held, [count, *row])]
        keys = list(total)
        yield pa.record_batch({
            "part": pa.array([k[0] for k in keys], pa.int32()), "entry": pa.array([k[1] for k in keys], pa.int32()),
            "sums": pa.array([[str(v) for v in total[k]] for k in keys], pa.list_(pa.string())),
        })
    return run


def _codes(codebooks: list[np.ndarray], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(codebooks)
        for batch in batches:
            code, error = np.zeros((batch.num_rows, len(codebooks)), np.uint8), [0] * batch.num_rows
            for part, _, entry, distance in _assigned(batch, codebooks, trees, size):
                code[:, part] = entry
                error = [a + int(b) for a, b in zip(error, distance)]
            yield pa.record_batch({
                "id": batch.column("id"), "label": batch.column("label"), "code": pa.array([c.tobytes().hex() for c in code], pa.string()),
                "error": pa.array([e if e < 1 << 63 else None for e in error], pa.int64()),
            })
    return run


def fitted_codebooks(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of assignment and replacement by floored means, over all ``rows`` (id, packed).

    A task sums its parts per entry; the sums meet in a grouped aggregation, so the driver gets sums per entry and no vectors but the first.
    """
    first = rows.orderBy(F.col("id").isNull(), "id", "packed").limit(entries).select("packed").collect()
    books = np.split(as_type(unpacked([r["packed"] for r in first], size), object), parts, axis=1)
    for _ in range(rounds):
        partial = rows.select("packed").mapInArrow(_sums(books, size), "part int, entry int, sums array<string>")
        sums = [F.sum(F.get("sums", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size // parts + 1)]
        books = [book.copy() for book in books]
        for part, entry, count, *total in partial.groupBy("part", "entry").agg(*sums).collect():
            books[part][entry] = [int(v) // int(count) for v in total]
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per coded vector: id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x), ``scale`` a power of two; vectors are cut into equal parts, and each part is coded by
    the nearest entry of its codebook (at most 256 entries, two hex digits). Codebooks start as the parts
    of the vectors with the smallest ids. The nearest entry is found in a GNAT over the entries, which each task builds
    from the few entries of the round; the result is exact, ties included.

    Vectors that are null or hold null or non-finite components are left out. A vector whose length differs from that of
    the one with the smallest id, or isn't divisible by ``parts``, can't be coded with the others: its code and
    error are null. So is an error of 2^63 or more. Null ids rank last; of equal ids the vector with the
    smaller bytes comes first. Repeated rows each count and each give a row. Null labels are one label. An
    empty table gives an empty result. Other columns are not read, whatever their names.
    """
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    rows = staged(given.where(F.col("vector").isNotNull() & finite).mapInArrow(
        _integers(scale), f"id {kinds['id']}, label {kinds['label']}, packed binary"))
    smallest = rows.orderBy(F.col("id").isNull(), "id", "packed").select(F.octet_length("packed").alias("n")).first()
    size = smallest["n"] // 8 if smallest else 0
    alike = (F.octet_length("packed") == 8 * size) & F.lit(size > 0 and size % parts == 0)
    coded = rows.where(alike)
    books = fitted_codebooks(coded, size, parts, entries, rounds) if size and size % parts == 0 else []
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    told = coded.mapInArrow(_codes(books, size), schema) if books else rows.limit(0).selectExpr("id", "label", "'' AS code", "0L AS error")
    others = rows.where(~alike).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    # Labels as text with a mark, so that null is a value like any other.
    done = checkpointed(told.unionByName(others).withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))).drop("label"))
    totals = checkpointed(done.groupBy("of").agg(F.sum("error").alias("label_error")))
    text = ",".join(str(v) for book in books for v in book.flat)
    return done.join(broadcast_if_small(totals, 128), "of").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
