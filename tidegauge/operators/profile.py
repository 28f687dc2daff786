"""Univariate profiles: descriptive statistics, histograms, top values, box statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import (
    as_text,
    c,
    categorical_columns,
    near_zero,
    numeric_columns,
    present,
    share,
)
from tidegauge.plans.counts import column_summary, long_numbers, top_values, value_counts
from tidegauge.plans.heavy import top_counts
from tidegauge.plans.ordered import QUARTILES, quantiles
from tidegauge.plans.sizing import attach, is_small, is_tiny, materialised, rows_of

PROFILE_SCHEMA = (
    "column string, n bigint, mean double, std double, variance double, min double, max double, "
    "skewness double, kurtosis double, p25 double, p50 double, p75 double"
)


def adjusted_skewness(value: Column, n: Column, flat: Column) -> Column:
    """Sample skewness with the small-sample correction; zero when the data do not vary."""
    raw = F.when(flat, F.lit(0.0)).otherwise(F.skewness(value))
    return F.when(n > 2, F.try_divide(raw * F.sqrt(n * (n - 1.0)), n - 2.0))


def adjusted_kurtosis(value: Column, n: Column, flat: Column) -> Column:
    corrected = F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(value) + 6.0)
    return F.when((n > 3) & flat, F.lit(0.0)).when(n > 3, corrected)


def _moments(value: Column, shape: bool = True) -> list[Column]:
    """Moments from few accumulators; ``shape`` adds the third and fourth."""
    n, flat, variance = F.count(value), F.min(value) == F.max(value), F.var_samp(value)
    none = F.lit(None).cast("double")
    return [
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.sqrt(variance).alias("std"),
        variance.alias("variance"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (adjusted_skewness(value, n, flat) if shape else none).alias("skewness"),
        (adjusted_kurtosis(value, n, flat) if shape else none).alias("kurtosis"),
    ]


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, small: bool | None = None, shape: bool = True
) -> DataFrame:
    """Moments and quartiles per numeric column, missing values skipped.

    Moments come from one map-side aggregate without a shuffle of rows; quartiles from the order
    statistics of all columns at once. ``shape`` off leaves skewness and kurtosis NULL.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    if small is None:
        small = is_small(df)
    inline = small and is_tiny(df)
    aggregates = []
    for i, name in enumerate(names):
        value = present(df, name).cast("double")
        fields = _moments(value, shape)
        if inline:
            every = F.percentile(value, F.array(*[F.lit(p) for p in QUARTILES.values()]))
            fields += [every[j].alias(q) for j, q in enumerate(QUARTILES)]
        aggregates.append(F.struct(F.lit(name).alias("column"), *fields).alias(f"s{i}"))
    summary = rows_of(df.agg(*aggregates), [F.col(f"s{i}") for i in range(len(names))])
    if inline:
        return summary
    quartiles = quantiles(long_numbers(df, names), ["column"], "value", QUARTILES, small=small)
    return summary.join(F.broadcast(quartiles), "column", "left")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation and five-number summary."""
    rows = numeric_summary(df, columns, shape=False)
    return rows.filter(F.col("n") > 0).select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full profile of every numeric column that varies."""
    rows = numeric_summary(df, columns).filter(F.col("min") != F.col("max"))
    spread = F.when(F.col("mean") != 0, F.try_divide(F.col("std"), F.col("mean")))
    return rows.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("coefficient_variation", spread)


def bin_count(n: Column, low: Column, high: Column, iqr: Column) -> Column:
    """Automatic bin count: the narrower of the Freedman-Diaconis and Sturges widths."""
    spread = high - low
    sturges = spread / (F.log2(n) + 1.0)
    freedman = 2.0 * iqr / F.pow(n.cast("double"), F.lit(1.0 / 3.0))
    width = F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges)
    return F.when(width > 0, F.ceil(spread / width)).otherwise(F.lit(1)).cast("int")


def histogram_layout(summary: DataFrame) -> DataFrame:
    """Edges of the automatic histogram of each summarised column."""
    flat = F.col("min") == F.col("max")
    return summary.filter(F.col("n") > 0).select(
        "column",
        F.when(flat, F.col("min") - 0.5).otherwise(F.col("min")).alias("low"),
        F.when(flat, F.col("max") + 0.5).otherwise(F.col("max")).alias("high"),
        bin_count(F.col("n"), F.col("min"), F.col("max"), F.col("p75") - F.col("p25")).alias("bins"),
    )


def _edge(index: Column) -> Column:
    step = (F.col("high") - F.col("low")) / F.col("bins")
    return F.when(index == F.col("bins"), F.col("high")).otherwise(F.col("low") + index * step)


def _bin_counts(df: DataFrame, names: Sequence[str], edges: DataFrame) -> DataFrame:
    """Rows per column and bin: a search among the bin edges per value, counted before anything is shuffled.

    Edges too close for a double to tell apart are one; its rows belong to the last of their bins.
    """
    bounds: dict[str, dict] = {}
    for row in edges.orderBy("column", "bin").collect():
        if row["left"] is not None and math.isfinite(row["left"]):
            bounds.setdefault(row["column"], {})[row["left"]] = row["bin"]
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, bin int, count bigint")
    found = [n for n in names if n in bounds]
    rows, parts = df.select(*[present(df, n).cast("double").alias(f"v{i}") for i, n in enumerate(found)]), []
    for i, n in enumerate(found):
        # Open ends take the largest value into the last bin; nothing lies below the first.
        splits = [-math.inf, *bounds[n], math.inf]
        rows = Bucketizer(splits=splits, inputCol=f"v{i}", outputCol=f"b{i}", handleInvalid="keep").transform(rows)
        parts.append((n, [None, *bounds[n].values()], f"b{i}"))
    long = F.stack(F.lit(len(parts)), *[p for k, (_, _, b) in enumerate(parts) for p in (F.lit(k), F.col(b))]).alias("at", "spot")
    counts = rows.select(long).filter("spot IS NOT NULL").groupBy("at", "spot").agg(F.count("*").alias("count"))
    place = F.array(*[F.lit(n) for n, _, _ in parts]), F.array(*[F.array(*[F.lit(b).cast("int") for b in bins]) for _, bins, _ in parts])
    return counts.select(F.get(place[0], F.col("at")).alias("column"), F.get(F.get(place[1], F.col("at")), F.col("spot").cast("int")).alias("bin"), "count")


def histogram(df: DataFrame, columns: Sequence[str] | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Automatic equal-width histogram of each numeric column, empty bins included."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if summary is None:
        summary = numeric_summary(df, names, shape=False)
    layout = materialised(histogram_layout(summary))  # one row per column
    every = layout.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    edges = materialised(every.select("column", "bin", _edge(F.col("bin")).alias("left"), _edge(F.col("bin") + 1).alias("right")))
    counted = _bin_counts(df, names, edges)
    return edges.join(F.broadcast(counted), ["column", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def top_categories(df: DataFrame, k: int = 10, counts: DataFrame | None = None, sketched: bool | None = None) -> DataFrame:
    """Most frequent labels per categorical column; percentages are of all rows.

    Without ``counts`` a large table is read through a sketch of its frequent values (``sketched`` forces either way).
    """
    names = categorical_columns(df)
    if counts is None and names and (not is_small(df) if sketched is None else sketched):
        top = top_counts(df, names, k)
    else:
        counts = (value_counts(df, names) if counts is None else counts).filter(F.col("column").isin(*names))
        top = top_values(counts, k).join(F.broadcast(column_summary(counts).select("column", "n_rows")), "column")
    return (
        top
        .select("column", "rank", "value", F.col("n").alias("count"), share(F.col("n"), F.col("n_rows")).alias("pct"))
    )


def categorical_profile(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Number of labels, the ten most frequent and the weight of the rest."""
    names = categorical_columns(df)
    if counts is None:
        counts = value_counts(df, names).persist()
    counts = counts.filter(F.col("column").isin(*names))
    summary = column_summary(counts)
    top = top_values(counts, 10).groupBy("column").agg(F.sum("n").alias("top"))
    other = F.col("n_rows") - F.col("missing") - F.coalesce("top", F.lit(0))
    return summary.join(top, "column", "left").select(
        "column",
        F.col("distinct_values").alias("total_categories"),
        other.alias("other_count"),
        share(other, F.col("n_rows")).alias("other_pct"),
    )


def period_counts(df: DataFrame, period: str) -> DataFrame:
    """Rows per period in text order; ``available`` tells whether there is more than one."""
    counts = df.select(as_text(df, period).alias("period")).filter(F.col("period").isNotNull()).groupBy("period").agg(
        F.count("*").alias("count")
    ).persist()
    periods = counts.agg((F.count("*") > 1).alias("available"))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(periods.withColumn("one", F.lit(1))), "one").drop("one")


def fences(low: Column, high: Column) -> tuple[Column, Column]:
    """Tukey fences from the quartiles, absent when the quartiles coincide."""
    spread = high - low
    usable = ~near_zero(spread)
    return F.when(usable, low - 1.5 * spread), F.when(usable, high + 1.5 * spread)


def box_stats(df: DataFrame, by: Sequence[str], value: str, small: bool | None = None) -> DataFrame:
    """Box statistics per group: moments, quartiles, fences and the rows outside them."""
    keys = [c(k) for k in by]
    rows = df.select(*keys, present(df, value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    counts = materialised(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n")))
    if small is None:
        small = is_small(counts)
    moments = rows.groupBy(*keys).agg(*_moments(F.col("__v")))
    quartiles = quantiles(counts, by, "__v", QUARTILES, weight="__n", small=small)
    low, high = fences(F.col("p25"), F.col("p75"))
    stats = _matched(moments, quartiles, by) if by else _side_by_side(moments, quartiles)
    stats = stats.withColumn("lower_bound", low).withColumn("upper_bound", high).withColumn("__rows", F.col("n"))
    if by:
        bounds = stats.select(*keys, "lower_bound", "upper_bound", "__rows")
        bounded = _bounded(counts, bounds, by)
    else:
        bounded = _side_by_side(counts, stats.select("lower_bound", "upper_bound"))
    outside = (F.col("__v") < F.col("lower_bound")) | (F.col("__v") > F.col("upper_bound"))
    flagged = bounded.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(outside, F.col("__n"))), F.lit(0)).alias("outlier_count")
    )
    whole = _matched(stats, flagged, by) if by else _side_by_side(stats, flagged)
    return whole.select(
        *keys,
        "n",
        "mean",
        F.coalesce("std", F.lit(0.0)).alias("std"),
        "min", "p25", "p50", "p75", "max",
        F.coalesce("skewness", F.lit(0.0)).alias("skew"),
        (F.col("p75") - F.col("p25")).alias("iqr"),
        "lower_bound", "upper_bound", "outlier_count",
        (F.col("outlier_count") / F.col("n")).alias("outlier_ratio"),
    )


def _matched(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join of one-row-per-group tables; the group of NULL keys meets itself."""
    named = {k: f"__right_{i}" for i, k in enumerate(by)}
    other = right.select(*[c(n).alias(named.get(n, n)) for n in right.columns])
    same = [c(k).eqNullSafe(F.col(alias)) for k, alias in named.items()]
    return left.join(other, same).drop(*named.values())


def _bounded(counts: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fences beside every value of their group; rows of NULL keys, which equality misses, are joined by themselves."""
    keyed = F.lit(True)
    for k in by:
        keyed = keyed & c(k).isNotNull()
    plain = attach(counts.filter(keyed), bounds.filter(keyed), by, "__rows")
    loose = _matched(counts.filter(~keyed), bounds.filter(~keyed).drop("__rows"), by)
    return plain.unionByName(loose.select(*[c(n) for n in plain.columns]))


def _side_by_side(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the single row of a global aggregate to every row."""
    marked = one_row.withColumn("__one", F.lit(1))
    return left.withColumn("__one", F.lit(1)).join(F.broadcast(marked), "__one").drop("__one")


