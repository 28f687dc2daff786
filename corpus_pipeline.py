"""The corpus pipeline: language, exact and near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and reread
for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.common import shared_path, table
from tidegauge.llm.exact_dedup import exact_dedup
from tidegauge.llm.language_id import accepted_documents
from tidegauge.llm.mixing import mixed_documents
from tidegauge.llm.packing import pack
from tidegauge.llm.simhash import near_dedup


#: Fewer text pieces than by default, as workers still hold memory of earlier stages.
REMEMBERED = 250_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return accepted_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source targets take them."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along the curve, with their ids (little-endian, four bytes each)."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, remembered=REMEMBERED)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the tokenizer nor the hashes of the fingerprints and the sampling keys.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
