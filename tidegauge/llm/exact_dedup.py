"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACE, broadcast_if_small, checkpointed, numbered, text_of, unused


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def half_sha256(sha: Column) -> Column:
    """128 bits of the content's SHA-256."""
    return F.substring(sha, 1, 16)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 content_hash: Callable[[Column], Column] = half_sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and ``__row``.

    1. Rows shrink to id and SHA-256 of the normalised text, written once.
    2. Groups by the 128-bit hash: size and smallest id, pre-aggregated before the shuffle.
    3. Bytes are compared where a hash repeats: a group whose smallest and largest text agree holds
       one text. The texts of any other hash are told apart by the text itself.

    ``content_hash`` maps the binary SHA-256 to the group hash (tests pass a weak one).

    A null text is empty. A null id ranks after all others; a group of only null ids has a null
    keep_id. Of repeated rows with the same smallest id exactly one is kept. An empty table gives
    an empty result; other columns of the input are not looked at, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("norm"))
    sha = F.unhex(F.sha2(F.col("norm"), 256))
    rows = checkpointed(
        numbered(source.select("id", sha.alias("sha"))).withColumn("h", content_hash(F.col("sha"))).withColumn("alike", F.lit(""))
    )
    repeated = checkpointed(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    texts = source.select("norm", content_hash(sha).alias("h"))
    suspects = texts.join(broadcast_if_small(repeated, 64), "h", "left_semi")
    mixed = checkpointed(
        suspects.groupBy("h").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .where("low <> high").select("h")
    )
    if mixed.limit(1).count():
        # Collisions: these few rows carry their text as a second part of the group key.
        numbered_texts = numbered(source.withColumn("sha", sha)).withColumn("h", content_hash(F.col("sha")))
        told = numbered_texts.join(mixed.withColumn("mixed", F.lit(True)), "h", "left")
        rows = checkpointed(
            told.select("id", "sha", "__row", "h", F.when(F.col("mixed"), F.col("norm")).otherwise("").alias("alike"))
        )
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "__row"))
    # Written, so that the join below is of two plain tables and a hot group's rows can be split.
    groups = checkpointed(rows.groupBy("h", "alike").agg(F.count("*").alias("group_size"), first.alias("first")))
    return rows.join(groups, ["h", "alike"]).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("first.__row") == F.col("__row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "__row",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: all columns of ``docs``, one row of each group of equal texts.

    The row with the smallest id stays; of rows that share that id and text any one stays.
    """
    groups = checkpointed(exact_groups(docs, id_col, text_col))
    own, of_id, of_text = unused(docs, "own_digest", "kept_id", "kept_digest")
    keep = checkpointed(groups.where("kept").select(F.col(id_col).alias(of_id), F.col("text_sha256").alias(of_text)))
    digest = F.sha2(normalised(text_of(text_col)), 256)
    same = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_text))
    kept = docs.withColumn(own, digest).join(broadcast_if_small(keep, 128), same, "left_semi")
    again = groups.groupBy(id_col, "text_sha256").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([id_col, own]) if again else kept).drop(own)
