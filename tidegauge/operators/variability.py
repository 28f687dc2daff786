"""Variability scores: entropy, Gini impurity, coefficient of variation, custom index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.columns import analytical_columns, is_numeric, near_zero, numeric_columns, present, to_number
from tidegauge.operators.quality import as_warning
from tidegauge.plans.counts import value_counts
from tidegauge.plans.ordered import ordered_counts
from tidegauge.plans.sizing import checkpointed, is_small, rows_of

NUMERIC_SHARE = 0.9
MODES = ("freq_only", "ordinal_map")
STRATEGIES = ("frequency", "alphabetical")


def disorder(counts: DataFrame) -> DataFrame:
    """Shannon entropy in bits and Gini impurity of every counted column.

    Uses sums of n, n log n and n squared, so columns with any number of values combine map-side.
    """
    n = F.col("n").cast("double")
    sums = counts.filter(F.col("value").isNotNull()).groupBy("column").agg(
        F.sum(n).alias("total"), F.sum(n * F.log2(n)).alias("weighted"), F.sum(n * n).alias("squares")
    )
    return sums.select(
        "column",
        F.greatest(F.log2("total") - F.col("weighted") / F.col("total"), F.lit(0.0)).alias("entropy"),
        (1.0 - F.col("squares") / (F.col("total") * F.col("total"))).alias("gini_impurity"),
    )


def coefficient_of_variation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample deviation over mean; NULL with ``mean_near_zero`` where the mean vanishes."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        schema = "column string, coefficient_variation double, mean_near_zero boolean"
        return df.sparkSession.createDataFrame([], schema)
    aggregates = []
    for i, name in enumerate(names):
        value = present(df, name).cast("double")
        aggregates += [F.avg(value).alias(f"m{i}"), F.stddev_samp(value).alias(f"s{i}")]
    return rows_of(
        df.agg(*aggregates),
        [
            F.struct(
                F.lit(name).alias("column"),
                F.when(~near_zero(F.col(f"m{i}")), F.col(f"s{i}") / F.col(f"m{i}")).alias("coefficient_variation"),
                F.coalesce(near_zero(F.col(f"m{i}")), F.lit(False)).alias("mean_near_zero"),
            )
            for i, name in enumerate(names)
        ],
    )


def custom_index(
    counts: DataFrame, mode: str = "freq_only", strategy: str = "frequency"
) -> DataFrame:
    """Custom index per column: mean of numbers, 1.0, or the mean rank of the labels.

    The mean label rank needs no per-label position: labels that tie in frequency contribute the
    mean of their shared positions, weighted equally, so ranks come from ordered frequencies alone.
    """
    if mode not in MODES or strategy not in STRATEGIES:
        raise ValueError(f"mode must be one of {MODES} and strategy one of {STRATEGIES}")
    filled = counts.filter(F.col("value").isNotNull()).withColumn("number", to_number(F.col("value")))
    totals = filled.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("numbers"),
        F.sum(F.col("number") * F.col("n")).alias("weighted"),
    )
    numeric = F.col("numbers") / F.col("total") >= NUMERIC_SHARE
    base = totals.withColumn("numeric_like", numeric)
    if mode == "freq_only":
        index = F.when(F.col("numeric_like"), F.col("weighted") / F.col("total")).otherwise(F.lit(1.0))
        return base.select("column", index.alias("custom_index"), "numeric_like")
    if strategy == "frequency":
        ranks = filled.withColumn("__order", -F.col("n").cast("double"))
        ordered = ordered_counts(ranks, ["column"], "__order")
        # before = labels ahead, n = labels sharing this frequency, -__order = rows per label
        ranked_sum = F.sum((F.col("before") + (F.col("n") + 1) / 2.0) * F.col("n") * -F.col("__order"))
        scores = ordered.groupBy("column").agg(ranked_sum.alias("rank_sum"))
    else:
        scores = alphabetical_rank_sum(filled)
    index = F.when(F.col("numeric_like"), F.col("weighted")).otherwise(F.col("rank_sum")) / F.col("total")
    return base.join(scores, "column", "left").select("column", index.alias("custom_index"), "numeric_like")


def alphabetical_rank_sum(filled: DataFrame, small: bool | None = None) -> DataFrame:
    """Sum of label position times frequency with labels in text order.

    Beyond small inputs the labels are range-partitioned and written to the checkpoint folder, so
    the slices stay fixed; positions run inside a slice and slice totals supply the offset.
    """
    labels = filled.select("column", "value", "n")
    if small is None:
        small = is_small(labels)
    if small:
        cut = labels.withColumn("__slice", F.lit(0))
    else:
        cut = checkpointed(labels.repartitionByRange("column", "value").withColumn("__slice", F.spark_partition_id()))
    inside = Window.partitionBy("column", "__slice").orderBy("value")
    slices = cut.withColumn("__pos", F.row_number().over(inside)).groupBy("column", "__slice").agg(
        F.count("*").alias("labels"), F.sum(F.col("__pos") * F.col("n")).alias("inner"), F.sum("n").alias("weight")
    )
    earlier = Window.partitionBy("column").orderBy("__slice")  # one row per slice
    placed = slices.withColumn("__ahead", F.sum("labels").over(earlier) - F.col("labels"))
    return placed.groupBy("column").agg(
        F.sum(F.col("inner") + F.col("__ahead") * F.col("weight")).cast("double").alias("rank_sum")
    )


def variability_scores(df: DataFrame, mode: str = "freq_only", strategy: str = "frequency") -> DataFrame:
    """One row per analytical column; entropy and Gini for labels, variation for numbers."""
    names = analytical_columns(df)
    counts = value_counts(df, names).persist()
    listed = df.sparkSession.createDataFrame(
        [(n, "numeric" if is_numeric(df, n) else "categorical") for n in names], "column string, dtype_group string"
    )
    labels = F.col("dtype_group") == "categorical"
    scores = (
        listed.join(disorder(counts), "column", "left")
        .join(coefficient_of_variation(df), "column", "left")
        .join(custom_index(counts, mode, strategy), "column", "left")
    )
    return scores.select(
        "column",
        "dtype_group",
        F.when(labels, F.coalesce("entropy", F.lit(0.0))).alias("entropy"),
        F.when(labels, F.coalesce("gini_impurity", F.lit(0.0))).alias("gini_impurity"),
        "coefficient_variation",
        "custom_index",
        F.lit(mode).alias("custom_mode"),
        F.when(labels, F.lit("Prefer entropy and Gini impurity.")).otherwise(
            F.lit("Prefer the coefficient of variation, checked against the mean.")
        ).alias("recommendation"),
        F.coalesce("mean_near_zero", F.lit(False)).alias("mean_near_zero"),
        F.coalesce("numeric_like", F.lit(False)).alias("numeric_like"),
    )


def variability_warnings(scores: DataFrame) -> DataFrame:
    """Warnings implied by a score table."""
    column = F.col("column")
    labels = F.col("custom_index").isNotNull() & ~F.col("numeric_like")
    flat = scores.filter("mean_near_zero").select(
        *as_warning("cv_mean_near_zero", "warning", column, F.concat(column, F.lit(" has a mean close to zero.")),
                    "Use the deviation or the interquartile range.")
    )
    constant = scores.filter(labels & (F.col("custom_mode") == "freq_only")).select(
        *as_warning("custom_non_informative", "info", column, F.concat(F.lit("The index of "), column, F.lit(" is always 1.")),
                    "Use entropy or Gini impurity.")
    )
    mapped = scores.filter(labels & (F.col("custom_mode") == "ordinal_map")).select(
        *as_warning("custom_ordinal_map_warning", "warning", column, F.concat(F.lit("Ranks of "), column, F.lit(" are arbitrary numbers.")),
                    "Read the index with care.")
    )
    return flat.unionByName(constant).unionByName(mapped)


def variability_ranking(scores: DataFrame, metric: str, k: int = 20) -> DataFrame:
    """Columns with the highest finite score."""
    value = F.col(metric)
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return scores.filter(usable).select("column", value.alias("score")).orderBy(F.desc("score"), "column").limit(k)
