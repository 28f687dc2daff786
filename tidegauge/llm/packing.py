"""Packing of documents into token sequences along a Hilbert curve."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import staged, text_of
from tidegauge.llm.encoding import MEMORY, SPACE_AND_WORD, encoder, slices

BUCKETS, DIMENSIONS, BITS = 256, 4, 8
TIE_BITS = 63 - DIMENSIONS * BITS
SLICE_TOKENS = 64_000_000


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows, dimensions), after Skilling 2004."""
    axes = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for d in range(len(axes)):
            upper = (axes[d] & bit) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[d]) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0]) ^ swap
            if d:
                axes[d] = axes[d] ^ swap
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] & (1 << level)) != 0, flip ^ ((1 << level) - 1), flip)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> level) & 1)
    return key


class CurvePlace:
    """Curve position of documents: signed bucket counts of ids, projected to few dimensions, in cells."""

    def __init__(self, vocabulary: int, seed: int = 42):
        random = np.random.default_rng(seed)
        self.bucket = random.integers(0, BUCKETS, vocabulary)
        self.sign = random.choice([-1.0, 1.0], vocabulary)
        self.projection = random.standard_normal((BUCKETS, DIMENSIONS))

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        vectors = np.stack([np.bincount(self.bucket[ids], self.sign[ids], BUCKETS) for ids in documents])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        share = 1 / (1 + np.exp(-1.702 * (vectors @ self.projection)))
        cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        return hilbert_keys(cells)


def _tokenise(path: str, end_id: int, seed: int, remembered: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, SPACE_AND_WORD, remembered)
        place = CurvePlace(max(coder.tokenizer.get_vocab_size(), end_id + 1), seed)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in slices(batches):
            ids = [coder.encoded(t.as_py()) + end for t in batch.column("text")]
            arrays = [np.frombuffer(x, coder.dtype) for x in ids]
            yield pa.record_batch({
                "id": batch.column("id"), "tie": batch.column("tie"),
                "key": pa.array(place.keys(arrays)),
                "doc_tokens": pa.array([len(a) for a in arrays], pa.int64()),
                "ids": pa.array([a.astype("<u4").tobytes() for a in arrays] if coder.dtype.itemsize > 2 else ids, pa.binary()),
            })
    return run


def _cut(starts: np.ndarray, length: int, width: int, with_ids: bool, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = -1, 0
        for batch in batches:
            row_ids, slices, tokens = batch.column("id"), batch.column("slice").to_numpy(), batch.column("ids")
            out: dict[str, list] = {n: [] for n in schema.names if n != "id"}
            rows: list[int] = []
            for i in range(batch.num_rows):
                if slices[i] != current:
                    current, place = slices[i], int(starts[slices[i]])
                ids = np.frombuffer(tokens[i].as_py(), "<u2" if width == 2 else "<u4").astype("<u4")
                begin = 0
                while begin < len(ids):
                    offset = place % length
                    piece = ids[begin : begin + length - offset]
                    raw = piece.tobytes()
                    rows.append(i)
                    for name, value in (("start", begin), ("length", len(piece)), ("ids_crc32", zlib.crc32(raw)), ("doc_tokens", len(ids)),
                                        ("sequence_id", place // length), ("offset", offset), ("ids", raw)):
                        if name in out:
                            out[name].append(value)
                    begin, place = begin + len(piece), place + len(piece)
            taken = row_ids.take(pa.array(rows, pa.int64()))
            yield pa.record_batch([taken if n == "id" else pa.array(out[n], schema.field(n).type) for n in schema.names], schema=schema)
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0,
         seed: int = 42, with_ids: bool = False, remembered: int = MEMORY) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with its ``ids`` on demand.

    1. Each text is encoded once, with ``end_id`` behind it; its ids are hashed into a vector,
       projected to four dimensions and placed on a Hilbert curve. Ids are written as two bytes.
    2. Quantiles of the curve place, with ties broken by a hash of id and text, cut the documents into slices,
       so that neither many equal documents nor one place fill a slice. Token sums per slice give each slice's start.
    3. Slices are sorted along the curve and cut in one pass: neighbours fill sequences of
       ``length`` without a gap. A document longer than what is left goes on in the next sequence.
       Only the very last sequence is short.

    ``remembered`` bounds the text pieces a worker keeps encoded: more take memory, fewer take time, the result is the same.

    A null text is empty: its one id is ``end_id``. Repeated rows are documents of their own. A
    null id stays null. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    width = 2 if encoder(tokenizer_path, SPACE_AND_WORD).dtype.itemsize == 2 else 4
    text = text_of(text_col)
    tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 64 - TIE_BITS)
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), tie.alias("tie"))
    id_type = source.schema["id"].dataType.simpleString()
    encoded = source.mapInArrow(_tokenise(tokenizer_path, end_id, seed, remembered), f"id {id_type}, tie bigint, key bigint, doc_tokens bigint, ids binary")
    stage = staged(encoded.withColumn("place", F.shiftleft("key", TIE_BITS).bitwiseOR(F.col("tie"))).drop("key", "tie"))
    total = stage.agg(F.sum("doc_tokens")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE_TOKENS))
    cuts = stage.agg(F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def slice_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="right").astype(np.int32))

    sums = np.zeros(len(bounds) + 1, np.int64)
    for row in stage.groupBy(slice_of("place").alias("slice")).agg(F.sum("doc_tokens").alias("n")).collect():
        sums[row["slice"]] = row["n"]
    starts = np.concatenate([[0], np.cumsum(sums)[:-1]])
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
              ("sequence_id", pa.int64()), ("offset", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(source.schema["id"].dataType)), *fields])
    ddl = f"id {id_type}, " + ", ".join(f"`{k}` {'binary' if t == pa.binary() else 'bigint'}" for k, t in fields)
    ordered = (
        stage.withColumn("slice", slice_of("place")).repartitionById(len(bounds) + 1, F.col("slice"))
        .sortWithinPartitions("slice", "place", "id")
    )
    return ordered.select("id", "slice", "ids").mapInArrow(_cut(starts, length, width, with_ids, schema), ddl).withColumnRenamed("id", id_col)
