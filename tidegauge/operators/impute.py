"""Imputation and outlier diagnosis. The raw table is never changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import (
    MODE_FALLBACK,
    ZERO_TOLERANCE,
    Roles,
    c,
    is_numeric,
    is_technical,
    numeric_columns,
    present,
)
from tidegauge.operators.profile import numeric_summary
from tidegauge.operators.quality import missingness
from tidegauge.plans.counts import long_numbers, ranked, value_counts
from tidegauge.plans.ordered import quantiles
from tidegauge.plans.sizing import is_small, rows_of

# Strategy names and the robust z rule.
NO_IMPUTATION, BY_MEDIAN, BY_MODE = "none", "median", "mode"
ROBUST_Z_FACTOR, ROBUST_Z_LIMIT = 0.6745, 3.5


def modes(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Most frequent value per column, the smallest among equals (by number for numeric columns)."""
    names = list(columns)
    if counts is None:
        counts = value_counts(df, names)
    numeric = [n for n in names if is_numeric(df, n)]
    as_number = F.when(F.col("column").isin(*numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    filled = counts.filter(F.col("value").isNotNull() & F.col("column").isin(*names)).withColumn("__number", as_number)
    order = [F.desc("n"), F.asc_nulls_last("__number"), F.asc("value")]
    top = ranked(filled, ["column"], order, 1).select("column", F.col("value").alias("mode"), F.col("n").alias("mode_count"))
    listed = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    return listed.join(top, "column", "left").select(
        "column", F.coalesce("mode", F.lit(MODE_FALLBACK)).alias("mode"), F.coalesce("mode_count", F.lit(0)).alias("mode_count")
    )


def imputation_plan(df: DataFrame, roles: Roles = Roles()) -> list[tuple]:
    """``(column, missing, missing_pct, strategy, imputed, fill)`` per column, computed in two passes."""
    gaps = {r["column"]: (r["missing"], r["missing_pct"]) for r in missingness(df).collect()}
    gappy = [n for n in df.columns if gaps[n][0] > 0 and not is_technical(n)]
    by_median = [n for n in gappy if is_numeric(df, n) and n != roles.period]
    by_mode = [n for n in gappy if n not in by_median]
    fills: dict[str, object] = {}
    if by_median:
        medians = quantiles(long_numbers(df, by_median), ["column"], "value", {"m": 0.5}, small=is_small(df))
        found = {r["column"]: r["m"] for r in medians.collect()}
        fills |= {n: found.get(n, 0.0) if found.get(n) is not None else 0.0 for n in by_median}
    if by_mode:
        fills |= {r["column"]: r["mode"] for r in modes(df, by_mode).collect()}
    rows = []
    for name in df.columns:
        missing, pct = gaps[name]
        strategy = BY_MEDIAN if name in by_median else BY_MODE if name in by_mode else NO_IMPUTATION
        rows.append((name, missing, pct, strategy, missing if name in fills else 0, fills.get(name)))
    return rows


def impute(df: DataFrame, roles: Roles = Roles(), plan: list[tuple] | None = None) -> DataFrame:
    """Analysis copy: medians for numbers, modes for labels and the period, ids untouched."""
    projected = []
    for name, _, _, strategy, _, fill in plan or imputation_plan(df, roles):
        if strategy == NO_IMPUTATION:
            projected.append(c(name))
            continue
        kind = df.schema[name].dataType
        if strategy == BY_MEDIAN:
            projected.append(F.coalesce(present(df, name).cast("double"), F.lit(float(fill))).alias(name))
        else:
            projected.append(F.coalesce(present(df, name), F.lit(fill).try_cast(kind)).alias(name))
    return df.select(*projected)


def imputation_report(df: DataFrame, roles: Roles = Roles(), plan: list[tuple] | None = None) -> DataFrame:
    rows = [
        (name, missing, pct, strategy, imputed, None if fill is None else str(fill))
        for name, missing, pct, strategy, imputed, fill in plan or imputation_plan(df, roles)
    ]
    schema = "column string, missing bigint, missing_pct double, strategy string, imputed bigint, fill string"
    return df.sparkSession.createDataFrame(rows, schema)


def _limits(df: DataFrame, names: Sequence[str]) -> list[dict]:
    """Fences, median and median deviation per varying column: two exact quantile passes."""
    small = is_small(df)
    stats = [r.asDict() for r in numeric_summary(df, names, small, shape=False).collect()]
    stats = [s for s in stats if s["n"] and s["min"] != s["max"]]
    if not stats:
        return []
    shifted = df.select(
        *[F.abs(present(df, s["column"]).cast("double") - F.lit(s["p50"])).alias(s["column"]) for s in stats]
    )
    deviations = quantiles(
        long_numbers(shifted, [s["column"] for s in stats]), ["column"], "value", {"mad": 0.5}, small=small
    )
    mads = {r["column"]: r["mad"] for r in deviations.collect()}
    for s in stats:
        spread = s["p75"] - s["p25"]
        usable = abs(spread) > ZERO_TOLERANCE
        s["lower"] = s["p25"] - 1.5 * spread if usable else None
        s["upper"] = s["p75"] + 1.5 * spread if usable else None
        s["mad"] = mads[s["column"]] if abs(mads[s["column"]]) > ZERO_TOLERANCE else None
    return stats


def _flag(df: DataFrame, s: dict):
    value = present(df, s["column"]).cast("double")
    flag, score = F.lit(False), F.lit(None).cast("double")
    if s["lower"] is not None:
        flag = flag | (value < s["lower"]) | (value > s["upper"])
    if s["mad"] is not None:
        score = F.abs(F.lit(ROBUST_Z_FACTOR) * (value - F.lit(s["p50"])) / F.lit(s["mad"]))
        flag = flag | (score > ROBUST_Z_LIMIT)
    return F.coalesce(flag, F.lit(False)), score


def outlier_columns(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Flag counts per numeric column, and the rows flagged in any column. Nothing is filtered out.

    A value is flagged outside the Tukey fences or beyond the robust z limit.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    stats = _limits(df, names) if names else []
    spark = df.sparkSession
    schema = (
        "column string, flagged_count bigint, flagged_ratio double, lower_bound double, upper_bound double, "
        "max_abs_robust_z double"
    )
    if not stats:
        return spark.createDataFrame([], schema), spark.createDataFrame([(0, 0.0)], "flagged_rows bigint, flagged_ratio double")
    flags = [_flag(df, s) for s in stats]
    any_flag = F.greatest(*[f.cast("int") for f, _ in flags]) if len(flags) > 1 else flags[0][0].cast("int")
    totals = [F.count("*").alias("n"), F.coalesce(F.sum(any_flag), F.lit(0)).alias("flagged_rows")]
    for i, (flag, score) in enumerate(flags):
        totals += [F.sum(flag.cast("bigint")).alias(f"f{i}"), F.max(score).alias(f"z{i}")]
    counted = df.agg(*totals).persist()
    ratio = lambda part: F.round(part / F.greatest("n", F.lit(1)) * 100.0, 4)
    per_column = rows_of(
        counted,
        [
            F.struct(
                F.lit(s["column"]).alias("column"),
                F.col(f"f{i}").alias("flagged_count"),
                ratio(F.col(f"f{i}")).alias("flagged_ratio"),
                F.lit(s["lower"]).cast("double").alias("lower_bound"),
                F.lit(s["upper"]).cast("double").alias("upper_bound"),
                F.col(f"z{i}").alias("max_abs_robust_z"),
            )
            for i, s in enumerate(stats)
        ],
    )
    union = counted.select("flagged_rows", ratio(F.col("flagged_rows")).alias("flagged_ratio"))
    return per_column.orderBy(F.desc("flagged_count"), "column"), union
