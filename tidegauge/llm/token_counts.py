"""Token counts through a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACE, checkpointed, text_of
from tidegauge.llm.encoding import WORD_ONLY, encoder, slices

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the normal form that the cache relies on."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"|" + SPACE.encode()).hexdigest()


def one_space(text: Column) -> Column:
    """Normal form for tokenizers that drop white space: counts are the same before and after."""
    return F.regexp_replace(text, SPACE, " ")


def _encode(path: str, version: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(path, WORD_ONLY)
        for batch in slices(batches):
            counts = counter.counts(t.as_py() for t in batch.column("norm"))
            yield pa.record_batch({
                "digest": batch.column("digest"), "version": pa.array([version] * len(counts), pa.string()), "n_tokens": pa.array(counts),
            })
    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. New counts stay in ``cache_path``.

    Contents are keyed by the SHA-256 of their normal form and the tokenizer's version. Copies of
    a content are dropped before and after the shuffle, contents the cache holds are dropped by an
    anti join on the same partitioning, and only the rest is encoded and appended. All rows then
    join the cache on narrow keys. ``cache_path`` is on shared storage; a failed run appends
    nothing, and counts that two runs append at once are equal.

    For tokenizers of the library `tokenizers` that drop white space. A null text is empty and has
    no tokens. Repeated rows each give a row. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(cache_path)
    text = text_of(text_col)
    digest = F.unhex(F.sha2(one_space(text), 256))
    keys = checkpointed(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), digest.alias("digest")))
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    contents = docs.select(one_space(text).alias("norm"), digest.alias("digest")).dropDuplicates(["digest"])
    misses = contents.join(stored, "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    # Written, so that the join below is of two plain tables and a hot content's rows can be split.
    counts = checkpointed(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return keys.join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
