"""Comparison of the two flow tables over their shared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import is_numeric, is_technical, share
from tidegauge.operators.profile import numeric_summary
from tidegauge.plans.counts import column_summary, ranked, value_counts

FEW_VALUES = 12
CATEGORIES_SHOWN = 10


def shared_columns(in_df: DataFrame, out_df: DataFrame) -> list[str]:
    return [n for n in in_df.columns if n in out_df.columns and not is_technical(n)]


def split_shared(in_df: DataFrame, out_df: DataFrame, counts: tuple[DataFrame, DataFrame] | None = None) -> tuple[list[str], list[str]]:
    """Shared columns compared as numbers and as categories (numbers with few values count as categories)."""
    names = shared_columns(in_df, out_df)
    both = [n for n in names if is_numeric(in_df, n) and is_numeric(out_df, n)]
    if not both:
        return [], names
    left, right = counts or (value_counts(in_df, both), value_counts(out_df, both))
    widest = column_summary(left).unionByName(column_summary(right)).groupBy("column").agg(
        F.max("distinct_values").alias("d")
    )
    many = {r["column"] for r in widest.filter(F.col("d") > FEW_VALUES).collect()}
    numeric = [n for n in both if n in many]
    return numeric, [n for n in names if n not in numeric]


def compare_numeric(in_df: DataFrame, out_df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, deviation and range of each column on both sides."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        stats = numeric_summary(df, columns, shape=False)
        named = {"mean": "mean", "p50": "median", "std": "std", "min": "min", "max": "max"}
        return stats.select("column", *[F.col(k).alias(f"{prefix}_{v}") for k, v in named.items()])

    return side(in_df, "in").join(side(out_df, "out"), "column", "full_outer")


def compare_categories(
    in_df: DataFrame, out_df: DataFrame, columns: list[str], counts: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Ten most frequent labels over both sides with their count and share on each."""
    left, right = counts or (value_counts(in_df, columns).persist(), value_counts(out_df, columns).persist())
    left, right = left.filter(F.col("column").isin(*columns)), right.filter(F.col("column").isin(*columns))

    def labels(side: DataFrame, name: str) -> DataFrame:
        return side.filter(F.col("value").isNotNull()).select("column", "value", F.col("n").alias(name))

    def rows(side: DataFrame, name: str) -> DataFrame:
        return column_summary(side).select("column", F.col("n_rows").alias(name))

    joined = labels(left, "in_count").join(labels(right, "out_count"), ["column", "value"], "full_outer").na.fill(0)
    total = joined.withColumn("total", F.col("in_count") + F.col("out_count"))
    top = ranked(total, ["column"], [F.desc("total"), F.asc("value")], CATEGORIES_SHOWN)
    return (
        top.join(F.broadcast(rows(left, "in_rows")), "column", "left")
        .join(F.broadcast(rows(right, "out_rows")), "column", "left")
        .select(
            "column", "rank", F.col("value").alias("category"),
            "in_count", share(F.col("in_count"), F.coalesce("in_rows", F.lit(0))).alias("in_pct"),
            "out_count", share(F.col("out_count"), F.coalesce("out_rows", F.lit(0))).alias("out_pct"),
        )
    )
