"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACE, broadcast_if_small, checkpointed, columns_of, numbered, text_of, unused

SLICE_ROWS = 2_000


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1.5: grows with the share of letters among the characters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(0.5) + F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def word_count(text: Column) -> Column:
    """Number of words: gaps of white space between trimmed ends, plus one."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("bigint")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources ordered by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes. Targets stop at ``max_epochs`` times their source's size. With sources ordered by size per weight,
    those that stop are a prefix: sums before and behind each row tell where it ends, without rounds.
    One row per source passes through one window here, documents never do.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = W.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = W.partitionBy()
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    known = weighed.select(
        "source", "source_size", "w", "cap", F.sum("source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("all_w"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"), F.row_number().over(by_ratio).alias("place"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    stopped = F.col("cap") <= level * F.col("w")
    # The first that doesn't stop has the level of all behind it.
    shared = known.withColumn("level", F.min(F.when(~stopped, F.struct("place", level.alias("level")))).over(everything).level)
    return shared.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
        max_epochs: int = 3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, and ``__row``.

    A source first takes all its documents as often as its target holds its size (complete
    epochs). The rest of the target goes to documents by descending key u ** (1 / weight), u uniform
    from a hash of id, text and seed, until its words are used up; the document at the border gives the words that are missing.
    Sources are cut into slices along the key, so the prefix sum of a hot source runs in many
    tasks: sums per slice first, then rows inside a slice.

    A null text has size 0 and is never taken. A null source is a source, ordered last. Repeated
    rows are documents of their own, ordered by row. Equal keys are ordered by id. An empty table
    gives an empty result. The result depends on the rows, not on their layout, but for which of equal rows is cut.
    """
    text = text_of(text_col)
    lean = checkpointed(numbered(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        quality_weight(text).alias("weight"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"),
    )))
    u = (F.shiftrightunsigned("h", 11) + 1) / F.lit(float(2**53 + 1))
    keyed = lean.withColumn("key", F.pow(u, 1 / F.col("weight")))
    sizes = checkpointed(lean.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    targets = source_targets(sizes.select("source", "source_size"), max_epochs)
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    plan = checkpointed(targets.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("p_source"), "source_size", "target",
        F.coalesce(F.floor(rate + 1e-12), F.lit(0)).alias("epochs"),
        F.ceil(F.col("n") / slice_rows).alias("slices"),
    )).withColumn("budget", F.greatest(F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"), F.lit(0)))
    placed = keyed.join(broadcast_if_small(plan, 256), F.col("source").eqNullSafe(F.col("p_source"))).withColumn(
        "slice", F.least(F.floor((1 - F.col("key")) * F.col("slices")), F.col("slices") - 1)
    )
    slices = placed.groupBy("p_source", "slice").agg(F.sum("size").alias("slice_size"))
    along = W.partitionBy("p_source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = checkpointed(slices.select(
        F.col("p_source").alias("b_source"), F.col("slice").alias("b_slice"),
        F.coalesce(F.sum("slice_size").over(along), F.lit(0)).alias("slice_start"),
    ))
    within = W.partitionBy("p_source", "slice").orderBy(F.desc("key"), "id", "__row").rowsBetween(W.unboundedPreceding, -1)
    ordered = placed.join(
        broadcast_if_small(starts, 256), F.col("p_source").eqNullSafe(F.col("b_source")) & (F.col("slice") == F.col("b_slice"))
    ).withColumn("start", F.col("slice_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.least(F.col("budget") - F.col("start"), F.col("size")), F.lit(0))
    return ordered.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), "__row", "h",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    seed: int = 42, max_epochs: int = 3) -> DataFrame:
    """The mix as documents: each whole document as often as it is taken, the one at the border rounded.

    All columns of ``docs``. Documents that share id and text are taken alike, as the mean of their shares.
    """
    taken = mix(docs, id_col, text_col, source_col, seed, max_epochs)
    own, of, times, number = unused(docs, "own_key", "mixed_key", "mixed_times", "mixed_number")
    copies = checkpointed(
        taken.groupBy(F.col("h").alias(of)).agg(F.round(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))).cast("int").alias(times))
        .where(F.col(times) > 0)
    )
    keyed = docs.withColumn(own, F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)))
    return keyed.join(broadcast_if_small(copies, 64), F.col(own) == F.col(of)).select(
        *columns_of(docs), F.explode(F.sequence(F.lit(1), F.col(times))).alias(number)
    ).drop(number)
