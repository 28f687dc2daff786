"""Pairwise association: correlations, contingency tests, binned mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import (
    MISSING_LABEL,
    analytical_columns,
    as_text,
    c,
    categorical_columns,
    is_numeric,
    numeric_columns,
    present,
)
from tidegauge.functions.tails import chi2_p
from tidegauge.plans.counts import column_summary, long_numbers, ranked, value_counts
from tidegauge.plans.ordered import average_rank, ordered_counts, quantiles
from tidegauge.plans.sizing import attach, is_small, materialised, rows_of

# Label counts eligible for contingency tests, rows shown, preview size.
FEWEST_LABELS, MOST_LABELS = 2, 25
PAIRS_SHOWN, PREVIEW_SIDE = 10, 8
MIN_PAIR_ROWS, MIN_INFORMATION_ROWS = 3, 5
BINS = 10

PAIR_SCHEMA = "feature_x string, feature_y string"


def number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def varying_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with more than one value, from one min/max aggregate."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return []
    row = df.agg(*[(F.min(number(df, n)) != F.max(number(df, n))).alias(f"v{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[f"v{i}"]]


def correlation(x: Column, y: Column) -> Column:
    """Correlation over complete pairs, NULL without variation (the built-in raises there under ANSI mode)."""
    spread = F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(spread))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation and row count per pair, all pairs in one map-side aggregate."""
    if not pairs:
        return df.sparkSession.createDataFrame([], f"{PAIR_SCHEMA}, n bigint, pearson double")
    aggregates = []
    for i, (x, y) in enumerate(pairs):
        both = number(df, x).isNotNull() & number(df, y).isNotNull()
        aggregates += [F.count_if(both).alias(f"n{i}"), correlation(number(df, x), number(df, y)).alias(f"r{i}")]
    return rows_of(
        df.agg(*aggregates),
        [
            F.struct(
                F.lit(x).alias("feature_x"), F.lit(y).alias("feature_y"), F.col(f"n{i}").alias("n"),
                F.col(f"r{i}").alias("pearson"),
            )
            for i, (x, y) in enumerate(pairs)
        ],
    )


def _ranked_pairs(df: DataFrame, columns: list[str], pairs: Sequence[tuple[str, str]], small: bool) -> DataFrame:
    """Spearman of pairs of gap-free columns: equal rows collapse, every column is ranked once."""
    names = {n: f"c{i}" for i, n in enumerate(columns)}
    rows = df.select(*[number(df, n).alias(names[n]) for n in columns])
    weighted = materialised(rows.groupBy(*names.values()).agg(F.count("*").alias("w")))
    long = weighted.select(
        "w", F.stack(F.lit(len(names)), *[p for k in names.values() for p in (F.lit(k), F.col(k))]).alias("column", "value")
    )
    ordered = ordered_counts(long, ["column"], "value", weight="w", small=small).persist()
    for key in names.values():
        centred = average_rank() - (F.col("total") + 1) / 2.0
        lookup = ordered.filter(F.col("column") == key).select(
            F.col("value").alias(key), centred.alias(f"r_{key}"), F.col("n").alias("__weight")
        )
        weighted = attach(weighted, lookup, [key], "__weight")
    sums = [F.sum("w").alias("n")]
    for i, (x, y) in enumerate(pairs):
        rx, ry, w = F.col(f"r_{names[x]}"), F.col(f"r_{names[y]}"), F.col("w")
        sums += [F.sum(w * rx * ry).alias(f"xy{i}"), F.sum(w * rx * rx).alias(f"xx{i}"), F.sum(w * ry * ry).alias(f"yy{i}")]
    return rows_of(
        weighted.agg(*sums),
        [
            F.struct(
                F.lit(x).alias("feature_x"), F.lit(y).alias("feature_y"),
                F.try_divide(F.col(f"xy{i}"), F.sqrt(F.col(f"xx{i}") * F.col(f"yy{i}"))).alias("spearman"),
            )
            for i, (x, y) in enumerate(pairs)
        ],
    )


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], small: bool | None = None) -> DataFrame:
    """Spearman correlation per pair with tie-averaged ranks over the rows where both are present.

    Columns without gaps share one ranking; a pair with gaps is ranked on its own complete rows.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], f"{PAIR_SCHEMA}, spearman double")
    if small is None:
        small = is_small(df)
    columns = list(dict.fromkeys(n for pair in pairs for n in pair))
    gaps = df.agg(*[(F.count("*") - F.count(number(df, n))).alias(f"g{i}") for i, n in enumerate(columns)]).first()
    full = [n for i, n in enumerate(columns) if gaps[f"g{i}"] == 0]
    together = [p for p in pairs if p[0] in full and p[1] in full]
    parts = []
    if together:
        used = [n for n in full if any(n in p for p in together)]
        parts.append(_ranked_pairs(df, used, together, small))
    for pair in pairs:
        if pair not in together:
            complete = df.filter(number(df, pair[0]).isNotNull() & number(df, pair[1]).isNotNull())
            parts.append(_ranked_pairs(complete, list(pair), [pair], small))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long Pearson and Spearman matrix over the varying numeric columns (at least two are needed)."""
    names = varying_numbers(df, columns)
    pairs = list(combinations(names, 2))
    upper = pearson(df, pairs).drop("n").join(spearman(df, pairs), ["feature_x", "feature_y"])
    lower = upper.select(F.col("feature_y").alias("feature_x"), F.col("feature_x").alias("feature_y"), "pearson", "spearman")
    if len(names) < 2:
        return upper
    diagonal = df.sparkSession.createDataFrame(
        [(n, n, 1.0, 1.0) for n in names], f"{PAIR_SCHEMA}, pearson double, spearman double"
    )
    return upper.unionByName(lower).unionByName(diagonal)


def target_rankings(df: DataFrame, target: str) -> DataFrame:
    """Correlation of every varying numeric feature with the target, strongest Spearman first."""
    names = varying_numbers(df)
    if target not in names or len(names) < 2:
        return df.sparkSession.createDataFrame([], "feature string, pearson double, spearman double")
    pairs = [(n, target) for n in names if n != target]
    both = pearson(df, pairs).filter(F.col("n") >= MIN_PAIR_ROWS).join(spearman(df, pairs), ["feature_x", "feature_y"])
    return both.select(F.col("feature_x").alias("feature"), "pearson", "spearman").orderBy(
        F.desc(F.coalesce(F.abs("spearman"), F.lit(0.0))), "feature"
    )


def target_pearson(df: DataFrame, target: str) -> DataFrame:
    """Pearson correlation of each numeric feature with the target, strongest first."""
    pairs = [(n, target) for n in numeric_columns(df) if n != target]
    found = pearson(df, pairs).filter((F.col("n") >= MIN_PAIR_ROWS) & F.col("pearson").isNotNull())
    return found.select(F.col("feature_x").alias("feature"), "pearson").orderBy(F.desc(F.abs("pearson")), "feature")


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cross-tabulated counts of two columns over the rows where both are present."""
    pairs = df.select(as_text(df, x).alias("x_value"), as_text(df, y).alias("y_value"))
    return pairs.filter(F.col("x_value").isNotNull() & F.col("y_value").isNotNull()).groupBy("x_value", "y_value").agg(
        F.count("*").alias("count")
    )


def eligible_labels(df: DataFrame, counts: DataFrame | None = None) -> list[str]:
    """Categorical columns with a manageable number of labels, in table order."""
    names = categorical_columns(df)
    if not names:
        return []
    summary = column_summary(counts if counts is not None else value_counts(df, names))
    kept = summary.filter(F.col("distinct_values").between(FEWEST_LABELS, MOST_LABELS))
    found = {r["column"] for r in kept.collect()}
    return [n for n in names if n in found]


def pair_tables(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Contingency counts of every column pair from a single grouped pass.

    With at most 25 labels a side a pair has at most 625 cells, combined before the shuffle.
    """
    pairs = list(combinations(names, 2))
    texts = df.select(*[as_text(df, n).alias(f"t{i}") for i, n in enumerate(names)])
    at = {n: f"t{i}" for i, n in enumerate(names)}
    structs = F.array(*[
        F.struct(F.lit(x).alias("feature_x"), F.lit(y).alias("feature_y"), F.col(at[x]).alias("x_value"), F.col(at[y]).alias("y_value"))
        for x, y in pairs
    ])
    rows = texts.select(F.inline(structs)).filter(F.col("x_value").isNotNull() & F.col("y_value").isNotNull())
    return rows.groupBy("feature_x", "feature_y", "x_value", "y_value").agg(F.count("*").alias("count"))


def _test(tables: DataFrame) -> DataFrame:
    pair = ["feature_x", "feature_y"]
    rows = tables.groupBy(*pair, "x_value").agg(F.sum("count").alias("row_sum"))
    columns = tables.groupBy(*pair, "y_value").agg(F.sum("count").alias("column_sum"))
    shape = tables.groupBy(*pair).agg(
        F.sum("count").alias("n"), F.count_distinct("x_value").alias("r"), F.count_distinct("y_value").alias("k")
    ).filter((F.col("r") >= 2) & (F.col("k") >= 2))
    # At most 25 x 25 cells a pair; absent cells count zero.
    grid = rows.join(columns, pair).join(tables, [*pair, "x_value", "y_value"], "left").join(F.broadcast(shape), pair)
    expected = F.col("row_sum") * F.col("column_sum") / F.col("n")
    gap = F.abs(F.coalesce("count", F.lit(0)) - expected)
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    corrected = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return grid.groupBy(*pair, "n", "r", "k").agg(F.sum(corrected * corrected / expected).alias("chi2")).withColumn("dof", dof)


def cramers_v(chi2: Column, n: Column, r: Column, k: Column) -> Column:
    """Bias-corrected association strength."""
    below = F.greatest(n - 1, F.lit(1))
    phi2 = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / below)
    bound = F.least(k - F.pow(k - 1, F.lit(2)) / below, r - F.pow(r - 1, F.lit(2)) / below) - 1
    return F.when(bound > 0, F.sqrt(phi2 / bound))


def chi2_pairs(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Independence test of every eligible pair (continuity-corrected for two by two), strongest first."""
    names = list(names) if names is not None else eligible_labels(df)
    if len(names) < 2:
        schema = f"{PAIR_SCHEMA}, chi2 double, dof bigint, p_value double, cramers_v double, sample_size bigint"
        return df.sparkSession.createDataFrame([], schema)
    tested = _test(pair_tables(df, names).persist())
    return tested.select(
        "feature_x", "feature_y", "chi2", "dof",
        chi2_p(F.col("chi2"), F.col("dof").cast("double")).alias("p_value"),
        cramers_v(F.col("chi2"), F.col("n"), F.col("r"), F.col("k")).alias("cramers_v"),
        F.col("n").alias("sample_size"),
    ).orderBy(F.desc(F.coalesce("cramers_v", F.lit(0.0))), "feature_x", "feature_y").limit(PAIRS_SHOWN)


def contingency_preview(df: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """First eight by eight labels (text order) of the strongest pair."""
    best = (tests if tests is not None else chi2_pairs(df)).first()
    if best is None:
        return df.sparkSession.createDataFrame([], "x_value string, y_value string, count bigint")
    table = contingency(df, best["feature_x"], best["feature_y"]).persist()
    first_x = table.select("x_value").distinct().orderBy("x_value").limit(PREVIEW_SIDE)
    first_y = table.select("y_value").distinct().orderBy("y_value").limit(PREVIEW_SIDE)
    one = F.lit(1).alias("one")
    grid = first_x.select("x_value", one).join(first_y.select("y_value", one), "one").drop("one")
    return grid.join(table, ["x_value", "y_value"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Interior quantile edges of each numeric column; equal edges merge."""
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    rows = quantiles(long_numbers(df, columns), ["column"], "value", probs, small=is_small(df)).collect()
    return {r["column"]: sorted({r[q] for q in probs}) for r in rows}


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def mutual_information(df: DataFrame, target: str, bins: int = BINS) -> DataFrame:
    """Plug-in mutual information in nats of each feature with the binned target, highest first.

    Numbers are cut at quantiles after median imputation; missing labels form their own class.
    """
    rows = df.filter(number(df, target).isNotNull())
    features = [n for n in analytical_columns(df) if n != target]
    numeric = [n for n in features if is_numeric(df, n)]
    schema = "feature string, mi double"
    if not features or len(rows.take(MIN_INFORMATION_ROWS)) < MIN_INFORMATION_ROWS:
        return df.sparkSession.createDataFrame([], schema)
    medians = {
        r["column"]: r["m"]
        for r in quantiles(long_numbers(rows, numeric), ["column"], "value", {"m": 0.5}, small=is_small(rows)).collect()
    } if numeric else {}
    filled = rows.select(
        number(rows, target).alias("__y"),
        *[
            F.coalesce(number(rows, n), F.lit(float(medians.get(n) or 0.0))).alias(n) if n in numeric
            else F.coalesce(as_text(rows, n), F.lit(MISSING_LABEL)).alias(n)
            for n in features
        ],
    )
    edges = bin_edges(filled, ["__y", *numeric], bins)
    coded = filled.select(
        bin_index(F.col("__y"), edges["__y"]).alias("y"),
        *[(bin_index(c(n), edges[n]).cast("string") if n in numeric else c(n)).alias(f"x{i}") for i, n in enumerate(features)],
    )
    parts = [p for i, n in enumerate(features) for p in (F.lit(n), F.col(f"x{i}"))]
    joint = coded.select("y", F.stack(F.lit(len(features)), *parts).alias("feature", "x")).groupBy("feature", "x", "y").agg(
        F.count("*").alias("n")
    ).persist()
    log = lambda name: F.sum(F.col(name) * F.log(F.col(name).cast("double")))
    cells = joint.groupBy("feature").agg(F.sum("n").alias("total"), log("n").alias("cells"))
    by_x = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx")).groupBy("feature").agg(log("nx").alias("by_x"))
    by_y = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny")).groupBy("feature").agg(log("ny").alias("by_y"))
    total = F.col("total").cast("double")
    score = (F.col("cells") - F.col("by_x") - F.col("by_y")) / total + F.log(total)
    return cells.join(by_x, "feature").join(by_y, "feature").select(
        "feature", F.greatest(score, F.lit(0.0)).alias("mi")
    ).orderBy(F.desc("mi"), "feature")
