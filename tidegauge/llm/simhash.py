"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tidegauge.llm.common import broadcast_if_small, checkpointed, components, text_of, unused

SHINGLE, SEED, DISTANCE = 4, 42, 4
CHUNK = 1 << 15
#: Bit blocks of a fingerprint (first bit, bits). Four differing bits leave two of six blocks alike.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TILE = 32_768
FAN_OUT = 8
FRONTIER = 1 << 21
BATCH_ROWS = 65_536


def fingerprint(text: str) -> int:
    """64-bit SimHash over four-word shingles, words being lower-cased (A-Z) runs without ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = b"".join([xxh64_digest(joined[a:z], SEED) for a, z in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
        yield pa.record_batch({"id": batch.column("id"), "row_key": batch.column("row_key"), "fp": prints})


def gray_rank(fp: Column) -> Column:
    """Rank of a fingerprint among Gray codes, shifted so that signed order is rank order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _block_keys(fp: Column) -> Column:
    """One key for each pair of blocks: the pair's number before the bits of both."""
    part = [F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)) for first, bits in BLOCKS]
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    return F.array(*[
        F.lit(n << 22).bitwiseOR(F.shiftleft(part[i], BLOCKS[j][1])).bitwiseOR(part[j]) for n, (i, j) in enumerate(pairs)
    ])


class GrayTree:
    """Hierarchical index over fingerprints in Gray order, for several groups at once.

    A node stands for up to ``FAN_OUT`` neighbours of one group: ``mask`` has the bits in which all
    below agree, ``value`` those bits. A link search descends from pairs of roots. A
    pair carries the differences found so far; each level adds those in bits that its nodes
    fix and the upper ones didn't. Pairs over the distance are dropped with all below them.
    """

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        value, mask, owner = prints, np.full(len(prints), 2**64 - 1, np.uint64), groups
        self.levels = [(value, mask, owner, None)]
        while len(owner) > 1 and (owner[1:] == owner[:-1]).any():
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            starts = np.flatnonzero(rank % FAN_OUT == 0)
            every, some = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~(every ^ some)
            value, owner = every & mask, owner[starts]
            self.levels.append((value, mask, owner, np.append(starts, len(rank))))

    def link(self) -> np.ndarray:
        """Root row of every row: the first row of its group that links reach."""
        parent = np.arange(len(self.levels[0][0]))
        top = np.arange(len(self.levels[-1][2]))
        stack = [(len(self.levels) - 1, top, top, np.zeros(len(top), np.int64))]
        while stack:
            level, a, b, seen = stack.pop()
            if level == 0:
                _unite(parent, a, b)
                continue
            if len(a) > FRONTIER // (FAN_OUT * FAN_OUT) and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:], seen[half:]), (level, a[:half], b[:half], seen[:half])]
                continue
            value, mask, _, starts = self.levels[level]
            below_value, below_mask = self.levels[level - 1][:2]
            shape = (len(a), FAN_OUT, FAN_OUT)
            left = np.broadcast_to((starts[a][:, None] + np.arange(FAN_OUT))[:, :, None], shape)
            right = np.broadcast_to((starts[b][:, None] + np.arange(FAN_OUT))[:, None, :], shape)
            real = (left < starts[a + 1][:, None, None]) & (right < starts[b + 1][:, None, None]) & (left <= right)
            if level == 1:
                real &= left != right
            pair = np.broadcast_to(np.arange(len(a))[:, None, None], shape)[real]
            left, right = left[real], right[real]
            fixed = below_mask[left] & below_mask[right] & ~(mask[a] & mask[b])[pair]
            found = seen[pair] + np.bitwise_count((below_value[left] ^ below_value[right]) & fixed)
            near = found <= DISTANCE
            left, right, found = left[near], right[near], found[near]
            if level > 1:
                whole = self._whole(parent, level - 1)
                apart = (whole[left] < 0) | (whole[left] != whole[right])
                left, right, found = left[apart], right[apart], found[apart]
            if len(left):
                stack.append((level - 1, left, right, found))
        return _roots(parent)

    def _whole(self, parent: np.ndarray, level: int) -> np.ndarray:
        """Component of a node whose rows are all linked already, else -1: nothing below can add a link."""
        label = _roots(parent)
        for _, _, _, starts in self.levels[1 : level + 1]:
            low, high = np.minimum.reduceat(label, starts[:-1]), np.maximum.reduceat(label, starts[:-1])
            label = np.where(low == high, low, -1)
        return label


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent[:] = above


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of row pairs: roots hook to the smallest root they meet until none is left."""
    while len(a):
        roots = _roots(parent)
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _linked(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    groups = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)]))
    unsigned = prints.view(np.uint64)
    root = GrayTree(unsigned, groups).link()
    moved = root != np.arange(len(root))
    return pa.record_batch({"a": pa.array(prints[moved]), "b": pa.array(prints[root[moved]])})


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span each (key, tile) group; rows come sorted by group and Gray rank."""
    keys, prints, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys.append(np.stack([batch.column(n).to_numpy() for n in ("key", "low", "high")], axis=1))
        prints.append(batch.column("fp").to_numpy())
        held += batch.num_rows
        if held < BATCH_ROWS:
            continue
        k, p = np.concatenate(keys), np.concatenate(prints)
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield _linked(k[:cut], p[:cut])
        keys, prints, held = [k[cut:]], [p[cut:]], len(k) - cut
    if held:
        yield _linked(np.concatenate(keys), np.concatenate(prints))


def near_links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the distance, not every pair.

    Fingerprints meet where two of six bit blocks are equal, which four differing bits can't avoid.
    A group of over ``tile`` is dealt into parts by hash, and each pair of parts is searched by a task of its own.
    """
    keyed = checkpointed(prints.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(sizes, "key").withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = dealt.select(
        "key", F.least("own", "other").cast("bigint").alias("low"), F.greatest("own", "other").cast("bigint").alias("high"),
        "fp", gray_rank(F.col("fp")).alias("gray"),
    )
    ordered = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "gray")
    return ordered.drop("gray").mapInArrow(_links, "a bigint, b bigint")


def _grouped(docs: DataFrame, id_col: str, text_col: str, tile: int) -> DataFrame:
    """(id, row_key, fp, root, component_id) of every row; row_key hashes id and text."""
    text = text_of(text_col)
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row_key"))
    id_type = source.schema["id"].dataType.simpleString()
    rows = checkpointed(source.mapInArrow(_fingerprints, f"id {id_type}, row_key bigint, fp bigint"))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("low_id")))
    roots = components(near_links(prints.select("fp"), tile))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    of_print = rooted.join(lowest, "root").select(F.col("fp").alias("of_fp"), "root", "component_id")
    return rows.join(of_print, F.col("fp") == F.col("of_fp")).select("id", "row_key", "fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per input row: id, fingerprint, component_id.

    Fingerprints are computed once and written. Equal ones collapse before the search. Components
    of fingerprints then join the rows.

    A null text has no words: its fingerprint is zero and links like any other. A null id takes
    part, but is nowhere a component's id unless all ids of the component are null. Repeated rows
    each give a row. An empty table gives an empty result. Other columns are not read.
    """
    return _grouped(docs, id_col, text_col, tile).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: all columns of ``docs``, one document of each component.

    The one with the smallest id stays, a null id only where there is no other; of rows that share id and text any one stays.
    """
    groups = checkpointed(_grouped(docs, id_col, text_col, TILE))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).row_key
    own, of = unused(docs, "own_key", "kept_key")
    keep = checkpointed(groups.groupBy("root").agg(first.alias(of)).select(of))
    keyed = docs.withColumn(own, F.xxhash64(F.col(id_col), text_of(text_col)))
    kept = keyed.join(broadcast_if_small(keep, 32), F.col(own) == F.col(of), "left_semi")
    again = groups.groupBy("row_key").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([own]) if again else kept).drop(own)
