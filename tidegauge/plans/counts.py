"""The value-count kernel: every frequency-based operator reads this one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.columns import analytical_columns, as_text, c, present, reject_nested

# Spark prunes rank filters below the shuffle up to this many rows per group.
RANK_PUSHDOWN_ROWS = 1_000
RANK_SPREAD = 512


def long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` rows with every value as text."""
    reject_nested(df, columns)
    names = list(columns)
    as_strings = df.select(*[as_text(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    pairs = [part for i, n in enumerate(names) for part in (F.lit(n), F.col(f"v{i}"))]
    return as_strings.select(F.stack(F.lit(len(names)), *pairs).alias("column", "value"))


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(column, value)`` rows with every value as a double, other columns carried along."""
    names = list(columns)
    carried = [c(k) for k in keep]
    doubles = df.select(*carried, *[present(df, n).cast("double").alias(f"__v{i}") for i, n in enumerate(names)])
    pairs = [part for i, n in enumerate(names) for part in (F.lit(n), F.col(f"__v{i}"))]
    return doubles.select(*carried, F.stack(F.lit(len(names)), *pairs).alias("column", "value"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)`` over the chosen columns; missing values count under a NULL value."""
    names = list(columns) if columns is not None else analytical_columns(df)
    return long_text(df, names).groupBy("column", "value").agg(F.count("*").alias("n"))


def column_summary(counts: DataFrame) -> DataFrame:
    """Rows, missing cells, distinct values and the top frequency of each column."""
    filled = F.col("value").isNotNull()
    return counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.max(F.when(filled, F.col("n"))), F.lit(0)).alias("top_count"),
    )


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Each task keeps only its own first ``k`` before any shuffle.

    Small ``k`` uses Spark's own rank pruning; a larger one ranks hashed shares of each group
    first, so no task ever holds a whole group.
    """
    keys = [c(g) for g in group]
    if k > RANK_PUSHDOWN_ROWS:
        share = F.pmod(F.xxhash64(*[c(n) for n in df.columns]), F.lit(RANK_SPREAD))
        part = Window.partitionBy(*keys, "__share").orderBy(*order)
        df = (
            df.withColumn("__share", share)
            .withColumn("__r", F.row_number().over(part))
            .filter(F.col("__r") <= k)
            .drop("__share", "__r")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent values per column, ties by label."""
    filled = counts.filter(F.col("value").isNotNull())
    return ranked(filled, ["column"], [F.desc("n"), F.asc("value")], k)
