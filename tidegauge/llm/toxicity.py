"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, checkpointed, text_of
from tidegauge.llm.language_model import fold

ORDERS = (3, 4, 5)
BUCKET_BITS = 20
BLOCK_BITS = 12
FEATURES = 1024
FIT_ROWS = 20_000
#: Groups of the buckets without a weight of their own: by documents (powers of two) and by log ratio.
SUPPORTS = 16
EDGES = np.array([-4.0, -2.0, -1.0, 0.0, 1.0, 2.0, 4.0])
SMOOTHING = 1.0
PENALTY = 1e-4
STEPS = 400
THRESHOLD = 0.7


def gram_buckets(text: str) -> np.ndarray:
    """Bucket of every character n-gram of the lower-cased text with single spaces, repeats included."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in ORDERS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for i in range(n):
            h = (h ^ points[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and block of buckets: packed numbers of documents of either label that hold a bucket."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            counts[label, np.unique(gram_buckets(text))] += 1
    size = 1 << BLOCK_BITS
    if counts.any():
        for block in range(1 << (BUCKET_BITS - BLOCK_BITS)):
            part = counts[:, block * size : (block + 1) * size]
            yield pa.record_batch({"block": pa.array([block], pa.int32()), "counts": pa.array([part.astype("<u4").tobytes()], pa.binary())})


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packed counts. A task holds the sums of its blocks only, however many tasks counted."""
    size, sums = 1 << BLOCK_BITS, {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(data, "<u4").reshape(2, size).astype(np.int64)
            sums[block] = sums[block] + part if block in sums else part
    for block, part in sums.items():
        seen = np.flatnonzero(part.sum(axis=0))
        yield pa.record_batch({
            "bucket": pa.array((seen + block * size).astype(np.int32)), "clean": pa.array(part[0, seen]), "toxic": pa.array(part[1, seen]),
        })


class Tail:
    """Sums of naive Bayes log ratios over the buckets without a weight of their own, by group.

    Pseudo-counts are in proportion to the labels, so a bucket that was never counted says nothing.
    A row that is fitted leaves its own document out of the counts.
    """

    def __init__(self, counts: np.ndarray, rows: np.ndarray, own: np.ndarray):
        self.counts, self.rows, self.places = counts, rows, _places(own)
        self.groups, self.ratios = zip(*(self._of(label) for label in (None, 0, 1)))

    def _of(self, label: int | None) -> tuple[np.ndarray, np.ndarray]:
        counts, rows = self.counts.astype(np.float64), self.rows.astype(np.float64)
        if label is not None:
            counts[label] = np.maximum(counts[label] - 1, 0)
            rows[label] = max(rows[label] - 1, 1)
        share = rows / rows.sum()
        ratio = np.log((counts[1] + SMOOTHING * share[1]) / rows[1]) - np.log((counts[0] + SMOOTHING * share[0]) / rows[0])
        support = np.minimum(np.log2(counts.sum(axis=0) + 1).astype(np.int64), SUPPORTS - 1)
        return (support * (len(EDGES) + 1) + np.searchsorted(EDGES, ratio)).astype(np.int32), ratio.astype(np.float32)

    def features(self, text: str, label: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's buckets with a weight of their own, and the sums of the others by group."""
        held = np.unique(gram_buckets(text))
        places = self.places[held]
        rest, k = held[places < 0], 0 if label is None else label + 1
        sums = np.bincount(self.groups[k][rest], self.ratios[k][rest], SUPPORTS * (len(EDGES) + 1))
        return places[places >= 0], sums / np.sqrt(len(rest) + 1)


def _features(model: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = Tail(*model.value)
        for batch in batches:
            found = [tail.features(t, y) for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())]
            yield pa.record_batch({
                "label": batch.column("label"), "held": pa.array([h for h, _ in found], pa.list_(pa.int64())),
                "sums": pa.array([x for _, x in found], pa.list_(pa.float64())),
            })
    return run


def _places(buckets: np.ndarray) -> np.ndarray:
    found = np.full(1 << BUCKET_BITS, -1, np.int64)
    found[buckets] = np.arange(len(buckets))
    return found


def fitted(held: list[np.ndarray], sums: np.ndarray, labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights per bucket, ratio included, weights per group, and bias: logistic regression with an L2 penalty by full-batch Adam."""
    rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
    columns = np.concatenate(held) if held else np.empty(0, np.int64)
    scale, n = ratios[columns], len(ratios)
    spread = sums.std(axis=0)
    spread = np.where(spread > 1e-9, spread, np.inf)
    sums = sums / spread
    w, bias = np.zeros(n + sums.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[columns] * scale, len(held)) + sums @ w[n:] + bias
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        slope = np.append(np.bincount(columns, miss[rows] * scale, n), miss @ sums)
        gradient = np.append(slope / len(held) + PENALTY * w, miss.mean())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w[:n] * ratios, w[n:] / spread, float(bias)


def _scores(model: object, weights: np.ndarray, group_weights: np.ndarray, bias: float, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = Tail(*model.value) if model is not None else None
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            if tail is not None:
                for i, text in enumerate(batch.column("text").to_pylist()):
                    held, sums = tail.features(text)
                    z[i] += weights[held].sum() + sums @ group_weights
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.record_batch({
                "id": batch.column("id"), "held_out": batch.column("held_out"), "score": pa.array(score, pa.float64()),
                "predicted": pa.array((score >= threshold).astype(np.int32)),
            })
    return run


def fitting_rows(train: DataFrame, hashes: DataFrame, fit_rows: int) -> DataFrame:
    """(label, text) of at most ``fit_rows`` rows of ``train``: those with the smallest hash ``h`` of id and text, equal ones once."""
    border = hashes.select("h").distinct().orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    return train.where(F.xxhash64("id", "text") <= border).dropDuplicates(["id", "text"]).select("label", "text")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3,
                    held_fold: int = 1, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    1. For every labelled text outside the held-out fold, tasks count the documents of either label
       that hold each n-gram bucket; counts travel packed by block of buckets.
    2. The ``FEATURES`` buckets that tell the labels apart best (likelihood ratio of presence) get the
       log ratio of their smoothed frequencies and a weight each. All other counted buckets give sums of their naive
       Bayes ratios by group (documents that hold them, size of the ratio), with a weight per group.
    3. Weights are fitted on at most ``fit_rows`` labelled rows, those with the smallest hash of id and text, equal ones once,
       and all texts are scored in one pass.

    Labels that are null or of ids without a document are not used; where an id has several labels the
    largest counts. With rows of one label only (or none) every score is the share of toxic rows
    after one virtual row of each label. A null text is empty; its score follows from the bias. A
    null id has no label. Repeated rows each give a row. An empty table gives an empty result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"))
    marks = checkpointed(
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(fold(F.col(id_col), folds) != held_fold)
        .groupBy(F.col(id_col).alias("of_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    )
    train = source.where(~F.col("held_out")).join(broadcast_if_small(marks, 32), F.col("id") == F.col("of_id")).select("id", "text", "label")
    ids = checkpointed(source.where(~F.col("held_out")).select("id", F.xxhash64("id", "text").alias("h")).join(marks, F.col("id") == F.col("of_id")).select("label", "h"))
    rows = dict(ids.groupBy("label").count().collect())
    clean, toxic = rows.get(0, 0), rows.get(1, 0)
    if not clean or not toxic:
        model, weights, group_weights, bias = None, np.empty(0), np.empty(0), float(np.log((toxic + 1) / (clean + 1)))
    else:
        packed = train.select("label", "text").mapInArrow(_document_counts, "block int, counts binary")
        counts = checkpointed(packed.repartition("block").mapInArrow(_bucket_counts, "bucket int, clean bigint, toxic bigint"))

        def gain(seen: str, of: int) -> Column:
            part, everything = F.col(seen) / of, (F.col("clean") + F.col("toxic")) / (clean + toxic)
            inside = F.when(F.col(seen) > 0, F.col(seen) * F.log(part / everything)).otherwise(0.0)
            return inside + F.when(F.col(seen) < of, (of - F.col(seen)) * F.log((1 - part) / (1 - everything))).otherwise(0.0)

        best = counts.orderBy(F.desc(F.round(gain("clean", clean) + gain("toxic", toxic), 6)), "bucket").limit(FEATURES).toPandas()
        buckets = best["bucket"].to_numpy(np.int64)
        ratios = np.log((best["toxic"] + SMOOTHING) / (toxic + 2 * SMOOTHING)) - np.log((best["clean"] + SMOOTHING) / (clean + 2 * SMOOTHING))
        every = counts.toArrow()
        both = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for label, name in enumerate(("clean", "toxic")):
            both[label, every.column("bucket").to_numpy()] = every.column(name).to_numpy()
        model = docs.sparkSession.sparkContext.broadcast((both, np.array([clean, toxic]), buckets))
        chosen = fitting_rows(train, ids, fit_rows).mapInArrow(_features(model), "label int, held array<bigint>, sums array<double>")
        sample = checkpointed(chosen).toArrow()
        held = [np.asarray(h.values, np.int64) for h in sample.column("held")]
        sums = np.asarray(pc.list_flatten(sample.column("sums"))).reshape(len(held), -1)
        weights, group_weights, bias = fitted(held, sums, sample.column("label").to_numpy().astype(float), ratios.to_numpy())
    id_type = source.schema["id"].dataType.simpleString()
    scored = source.mapInArrow(_scores(model, weights, group_weights, bias, threshold), f"id {id_type}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)
