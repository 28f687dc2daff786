"""Line dedup: frequent lines in a sharded perfect hash with arrays, which documents probe."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpointed, text_of
from tidegauge.llm.encoding import slices
from tidegauge.llm.perfect_hash import PerfectHash

STRIPPED = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a shard, and rows that probe a shard that isn't shared with all tasks.
SHARD_LINES, SHARD_PROBES = 1 << 13, 1 << 20
#: Most tasks over the shards; a task takes its shards one after another.
MOST_TASKS = 10_000
#: Lines whose arrays every task holds: 21 bytes each, 32 MiB together.
SHARED_LINES = 1_500_000
#: Keeper of lines whose holders all have a null id.
NO_ID = -(1 << 63)
SHARDS = "shard int, size bigint, hash binary, fingerprints binary, docs binary, keepers binary"


def long_lines(lines: list[str], min_chars: int) -> tuple[list[int], np.ndarray]:
    """Places of the lines whose key has ``min_chars`` code points, and 128 bits of each key."""
    places, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(STRIPPED)
            if len(key) >= min_chars:
                places.append(i)
                digests.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes: A-Z alone
    return places, np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _line_rows(min_chars: int, shared, shards: int) -> Callable:
    """A row for each distinct long line of a document that the shared shards don't hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(shared) if shared else {}
        for batch in slices(batches):
            ids, parts = batch.column("id"), []
            for text in batch.column("text"):
                found = long_lines(text.as_py().split("\n"), min_chars)[1]
                parts.append(np.unique(found, axis=0) if len(found) > 1 else found)
            keys = np.concatenate([*parts, np.zeros((0, 2), np.uint64)]).view(np.int64)
            a, b, owner = keys[:, 0].copy(), keys[:, 1].copy(), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            if loaded:
                new = probed(loaded, shards, a, b)[0] == 0
                a, b, owner = a[new], b[new], owner[new]
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b), "id": ids.take(pa.array(owner))})
    return run


def line_rows(docs: DataFrame, min_chars: int, shared=None, shards: int = 0) -> DataFrame:
    """(a, b, id): both halves of the key's hash for each distinct long line of ``docs`` (id, text), without those of the shared shards."""
    return docs.mapInArrow(_line_rows(min_chars, shared, shards), "a bigint, b bigint, id bigint")


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, docs, keeper): lines in at least ``min_docs`` documents and the largest id that holds each.

    Rows are distinct by line and id before lines meet, so a very common line arrives as partial counts.
    """
    count = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    counted = line_rows(docs, min_chars).groupBy("a", "b").agg(count.alias("docs"), F.coalesce(F.max("id"), F.lit(NO_ID)).alias("keeper"))
    return checkpointed(counted.where(F.col("docs") >= min_docs))


class Shard:
    """Arrays of some frequent lines in the order of a perfect hash of their first half."""

    def __init__(self, found: PerfectHash, fingerprints: np.ndarray, docs: np.ndarray, keepers: np.ndarray):
        self.hash, self.fingerprints, self.docs, self.keepers = found, fingerprints, docs, keepers

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, docs: np.ndarray, keepers: np.ndarray) -> Shard:
        keys, found = a.view(np.uint64), PerfectHash.build(a.view(np.uint64))
        order = np.empty(len(a), np.int64)
        order[found.numbers(keys)] = np.arange(len(a))
        return cls(found, b.view(np.uint64)[order], np.minimum(docs, (1 << 32) - 1).astype(np.uint32)[order], keepers[order])

    @classmethod
    def unpacked(cls, row) -> Shard:
        return cls(PerfectHash.unpacked(row["hash"]), np.frombuffer(row["fingerprints"], np.uint64),
                   np.frombuffer(row["docs"], np.uint32), np.frombuffer(row["keepers"], np.int64))

    def packed(self) -> dict:
        return {"hash": self.hash.packed(), "fingerprints": self.fingerprints.tobytes(), "docs": self.docs.tobytes(), "keepers": self.keepers.tobytes()}

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each line, 0 if it isn't in the shard, and the line's keeper."""
        at = self.hash.numbers(a.view(np.uint64))
        known = np.flatnonzero(at >= 0)
        known = known[self.fingerprints[at[known]] == b.view(np.uint64)[known]]
        docs, keepers = np.zeros(len(a), np.int64), np.full(len(a), NO_ID)
        docs[known], keepers[known] = self.docs[at[known]], self.keepers[at[known]]
        return docs, keepers


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(a, shards)


def _packed_shards(group: pd.DataFrame) -> pd.DataFrame:
    columns = [group[n].to_numpy(np.int64) for n in ("a", "b", "docs", "keeper")]
    return pd.DataFrame([{"shard": int(group["shard"].iloc[0]), "size": len(group), **Shard.build(*columns).packed()}])


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard. Lines are dealt by hash, so a shard holds about ``SHARD_LINES`` at every size.

    Lines that agree in the first half of their hash, some two among 10^10, can't share a perfect
    hash: each further one goes to a shard beyond the others, which all lines probe.
    """
    twins = lines.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    if not twins.limit(1).count():
        dealt = lines.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    else:
        firsts = lines.groupBy("a").agg(F.min("b").alias("first"))
        dealt = lines.join(firsts, "a").withColumn("shard", F.when(
            F.col("b") == F.col("first"), F.pmod("a", F.lit(shards))).otherwise(shards + F.pmod("b", F.lit(1 << 20))).cast("int"))
    dealt = dealt.select("shard", "a", "b", "docs", "keeper").repartition(min(shards, MOST_TASKS), "shard")
    return dealt.groupBy("shard").applyInPandas(_packed_shards, SHARDS)


def least_shared_count(lines: DataFrame, most: int) -> int:
    """The smallest count of documents that at most ``most`` lines reach, by halving its range: a short pass each."""
    low, high = 0, lines.agg(F.max("docs")).first()[0] + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if lines.where(F.col("docs") >= middle).count() <= most else (middle, high)
    return high


def _loaded(shared) -> dict[int, Shard]:
    return {number: Shard.unpacked(row) for number, row in shared.value.items()}


def probed(loaded: dict[int, Shard], shards: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and keepers of lines from the shards at hand."""
    docs, keepers, of = np.zeros(len(a), np.int64), np.full(len(a), NO_ID), shard_of(a, shards)
    for number, shard in loaded.items():
        at = np.flatnonzero(of == number) if number < shards else np.arange(len(a))
        found, keeper = shard.probe(a[at], b[at])
        docs[at[found > 0]], keepers[at[found > 0]] = found[found > 0], keeper[found > 0]
    return docs, keepers


def _answers(shards: int) -> Callable:
    """Counts and keepers of the lines that reach one shard."""
    def run(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        a, b = probes["a"].to_numpy(np.int64), probes["b"].to_numpy(np.int64)
        docs, keepers = probed({int(r["shard"]): Shard.unpacked(r) for r in shard.to_dict("records")}, shards, a, b)
        hit = docs > 0
        return pd.DataFrame({"id": probes["id"].astype("Int64")[hit], "a": a[hit], "b": b[hit], "docs": docs[hit], "keeper": keepers[hit]})
    return run


def other_answers(docs: DataFrame, lines: DataFrame, shared, shared_shards: int, min_chars: int) -> DataFrame:
    """(of, found): for each document its ``lines``, which aren't shared, answered by the tasks of their shards."""
    rows = checkpointed(line_rows(docs, min_chars, shared, shared_shards))
    shards = max(-(-lines.count() // SHARD_LINES), -(-rows.count() // SHARD_PROBES), 1)
    index = checkpointed(build_shards(lines, shards))
    beyond = [r["shard"] for r in index.where(F.col("shard") >= shards).select("shard").collect()]
    sent = rows.withColumn("shard", F.explode(F.array(F.pmod("a", F.lit(shards)).cast("int"), *[F.lit(n) for n in beyond])))
    tasks = min(shards, MOST_TASKS)
    answered = sent.repartition(tasks, "shard").groupBy("shard").cogroup(index.repartition(tasks, "shard").groupBy("shard")).applyInPandas(
        _answers(shards), "id bigint, a bigint, b bigint, docs bigint, keeper bigint")
    found = F.collect_list(F.struct("a", "b", "docs", "keeper")).alias("found")
    return checkpointed(answered.groupBy(F.col("id").alias("of")).agg(found))


def _applied(shared, shards: int, min_chars: int, with_text: bool) -> Callable:
    """Lines kept in each document, after probing the shared arrays and reading the answers that came by shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(shared)
        for batch in slices(batches):
            ids = batch.column("id").to_pylist()
            lines = [t.as_py().split("\n") for t in batch.column("text")]
            found = [long_lines(x, min_chars) for x in lines]
            ends = np.cumsum([0, *[len(places) for places, _ in found]])
            keys = np.concatenate([k for _, k in found]).view(np.int64)
            docs, keepers = probed(loaded, shards, keys[:, 0].copy(), keys[:, 1].copy())
            if "found" in batch.schema.names:
                for i, answers in enumerate(batch.column("found").to_pylist()):
                    known = {(x["a"], x["b"]): (x["docs"], x["keeper"]) for x in answers or ()}
                    for k in range(ends[i], ends[i + 1]) if known else ():
                        docs[k], keepers[k] = known.get((keys[k, 0], keys[k, 1]), (docs[k], keepers[k]))
            out = []
            for i, doc_id in enumerate(ids):
                part = slice(ends[i], ends[i + 1])
                gone = (docs[part] > 0) & (keepers[part] != (NO_ID if doc_id is None else doc_id))
                places = {found[i][0][k] for k in np.flatnonzero(gone)}
                kept = "\n".join(line for k, line in enumerate(lines[i]) if k not in places) if places else "\n".join(lines[i])
                out.append((len(lines[i]), len(places), int(docs[part].max(initial=0)), kept))
            columns = list(zip(*out))
            text = pa.array(columns[3], pa.string()) if with_text else pa.array([hashlib.sha256(t.encode()).hexdigest() for t in columns[3]])
            yield pa.record_batch({
                "id": batch.column("id"), "n_lines": pa.array(columns[0], pa.int64()), "n_dropped": pa.array(columns[1], pa.int64()),
                "most_docs": pa.array(columns[2], pa.int64()), "kept": text,
            })
    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               with_text: bool = False, shared_lines: int = SHARED_LINES) -> DataFrame:
    r"""One row per input row: id, n_lines, n_dropped, most_docs and kept_sha256, or with ``with_text`` kept_text.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines, but for those of
    the largest id. ``most_docs`` is the largest number of documents that hold one of the row's frequent lines.

    1. Long lines become 128 bits and are counted by Spark: documents and largest id of each.
    2. Frequent ones are dealt to shards by hash. A shard's task builds a minimal perfect hash of the first 64 bits
       and arrays of fingerprints (the other 64), counts and keepers in its order.
    3. Documents probe the arrays where they are. Up to ``shared_lines`` lines the arrays are sent to
       all tasks (at most 32 MiB); beyond, the less frequent ones stay in tables and the probes go to the shards.

    Ids are whole numbers. A null text is one empty line. Rows with the same id are one document;
    all rows with a null id are one document, which keeps a line only if no other holds it. Every row gives a row. An empty table gives
    an empty result. A task holds few texts at a time, so a very long text costs its own size a few
    times over. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    lines = frequent_lines(rows, min_chars, min_docs)
    total = lines.count()
    least = least_shared_count(lines, shared_lines) if total > shared_lines else 0
    shards = max(-(-min(total, shared_lines) // SHARD_LINES), 1)
    first = build_shards(lines.where(F.col("docs") >= least), shards)
    shared = spark.sparkContext.broadcast({r["shard"]: r.asDict() for r in first.collect()})
    if least:
        # Each of these lines is in fewer documents than each of so many others, so no shard is hot.
        answers = other_answers(rows, lines.where(F.col("docs") < least), shared, shards, min_chars)
        rows = rows.join(answers, F.col("id").eqNullSafe(F.col("of")), "left").drop("of")
    kept = "kept_text" if with_text else "kept_sha256"
    out = rows.mapInArrow(_applied(shared, shards, min_chars, with_text),
                          "id bigint, n_lines bigint, n_dropped bigint, most_docs bigint, kept string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_lines", "n_dropped", "most_docs", F.col("kept").alias(kept))
