"""Queries of the operators over the test tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import oracle
from tidegauge.llm.common import shared_path, table
from tidegauge.llm.exact_dedup import exact_groups
from tidegauge.llm.fill_middle import fill_in_middle
from tidegauge.llm.language_id import document_evidence, identify, page_evidence, text_model
from tidegauge.llm.language_model import language_model_scores
from tidegauge.llm.line_dedup import line_dedup
from tidegauge.llm.line_frequency import line_quality
from tidegauge.llm.mixing import mix
from tidegauge.llm.packing import pack
from tidegauge.llm.simhash import simhash_components
from tidegauge.llm.token_counts import count_tokens
from tidegauge.llm.toxicity import toxicity_scores
from tidegauge.llm.vector_codes import vector_codes
from tidegauge.llm.warc import warc_round_trip


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each run, so that every run encodes all distinct texts."""
    cache = shared_path(spark, "token-cache")
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(document_evidence(docs), text_model(docs)).withColumnRenamed("id", "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, whose markup and addresses are evidence too."""
    model = text_model(table(spark, sf_dir, "documents"))
    return identify(page_evidence(table(spark, sf_dir, "pages")), model).withColumnRenamed("id", "page_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("__row")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("__row", "h")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_language_model": op4_language_model,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "language_id_pages": language_id_pages,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL = {
    "op1_line_frequency": oracle.LINE_QUALITY,
    "op7_exact_dedup": oracle.EXACT_GROUPS,
    "op8_warc": oracle.WARC,
    "op11_line_dedup": oracle.LINE_DEDUP,
    "op12_vector_codes": oracle.vector_codes(),
    "op13_fill_in_middle": oracle.FILL_IN_MIDDLE,
}
