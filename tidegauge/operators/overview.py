"""Overview of the target: statistics, histogram, linear and general dependence, warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import Roles, as_number
from tidegauge.operators.association import mutual_information, target_pearson
from tidegauge.operators.inference import target_outliers, with_target
from tidegauge.operators.profile import histogram, numeric_summary
from tidegauge.operators.quality import quality_warnings, warning_rows


@dataclass(frozen=True)
class TargetOverview:
    present: bool
    stats: DataFrame | None
    histogram: DataFrame | None
    pearson: DataFrame | None
    mutual_information: DataFrame | None
    warnings: DataFrame


def target_stats(df: DataFrame, target: str) -> DataFrame:
    only = df.select(as_number(df, target).alias(target))
    return numeric_summary(only, [target], shape=False).select("n", "mean", "std", "min", "p25", "p50", "p75", "max")


def target_overview(df: DataFrame, target: str, roles: Roles = Roles()) -> TargetOverview:
    if target not in df.columns:
        note = ("missing_target", "warning", target, f"{target} is not in the table.", "Load a table with the target.")
        return TargetOverview(False, None, None, None, None, warning_rows(df, [note]))
    data = with_target(df, target)
    if not data.take(1):
        note = ("target_all_missing", "warning", target, f"{target} has no numeric value.", "Clean the target.")
        return TargetOverview(False, None, None, None, None, warning_rows(df, [note]))
    return TargetOverview(
        True,
        target_stats(data, target),
        histogram(data, [target]),
        target_pearson(data, target),
        mutual_information(data, target),
        quality_warnings(data, roles).unionByName(target_outliers(data, target)),
    )


def learning_facts(df: DataFrame, target: str) -> DataFrame:
    """Mean, median, skewness, upper fence and share above it of the whole target."""
    stats = numeric_summary(df.select(as_number(df, target).alias(target)), [target])
    spread = F.col("p75") - F.col("p25")
    facts = stats.select(
        "mean", F.col("p50").alias("median"), F.coalesce("skewness", F.lit(0.0)).alias("skew"),
        (F.col("p75") + 1.5 * spread).alias("upper_fence"), (F.abs(spread) <= 1e-8).alias("__flat"), F.lit(1).alias("__one"),
    )
    values = df.select(as_number(df, target).alias("v"), F.lit(1).alias("__one")).filter("v IS NOT NULL")
    tail = values.join(F.broadcast(facts.select("upper_fence", "__one")), "__one").groupBy("__one").agg(
        F.avg((F.col("v") > F.col("upper_fence")).cast("double")).alias("tail")
    )
    return facts.join(F.broadcast(tail), "__one").select(
        "mean", "median", "skew", "upper_fence", F.when(F.col("__flat"), F.lit(0.0)).otherwise(F.col("tail")).alias("tail_ratio")
    )
