"""Hypothesis tests and regression from distributed sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import (
    MISSING_LABEL,
    Roles,
    analytical_columns,
    as_number,
    as_text,
    c,
    is_numeric,
    present,
)
from tidegauge.functions.tails import chi2_p, f_p, f_tail, t_beyond, t_p, t_quantile, t_two_sided
from tidegauge.operators.absorption import NotConverged, absorb, vectors_of, without_each
from tidegauge.operators.association import correlation
from tidegauge.operators.profile import box_stats
from tidegauge.operators.quality import as_warning, empty_warnings, quality_warnings, warning_rows
from tidegauge.plans.counts import long_numbers
from tidegauge.plans.ordered import average_rank, ordered_counts, quantiles
from tidegauge.plans.sizing import attach, is_small, materialised, rows_of

# Fixed values of the reporting rules.
SMALL_GROUP, OUTLIER_SHARE, SIGNIFICANT = 5, 0.05, 0.05
BOX_FEATURES, TERMS_NAMED = 3, 3
MAX_DESIGN = 1_000
#: Levels of a label column that stays in the design beside several wide ones.
NARROW = 32
#: Times ``max_columns`` beyond which an estimate of a column's levels does; rows looked at before a column is searched for a second value.
SURELY_WIDE, SHOWN = 50, 100
#: Columns beside an eliminated one up to which its levels are handled by expressions, without Python.
FEW = 8
INFINITE = float("inf")
EXACT_FIT = 1e-14  # share of variance left below which a fit counts as exact

TEST_SCHEMA = (
    "feature string, feature_type string, test_used string, statistic double, p_value double, effect_size double, "
    "n_groups bigint, kruskal_statistic double, kruskal_p_value double, small_groups bigint, n bigint"
)


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a numeric target, the target as a double."""
    typed = df.select(*[(as_number(df, n).alias(n) if n == target else c(n)) for n in df.columns])
    return typed.filter(c(target).isNotNull())


def features_of(df: DataFrame, target: str) -> list[str]:
    return [n for n in analytical_columns(df, (target,)) if n != target]


def target_outliers(df: DataFrame, target: str) -> DataFrame:
    """Warning when more than five percent of the target lies outside the fences on either side."""
    values = df.select(as_number(df, target).alias("v")).filter("v IS NOT NULL")
    q = quantiles(values, [], "v", {"p25": 0.25, "p75": 0.75}).first()
    if q is None or q["p25"] is None or abs(q["p75"] - q["p25"]) <= 1e-8:
        return empty_warnings(df)
    low, high = 2.5 * q["p25"] - 1.5 * q["p75"], 2.5 * q["p75"] - 1.5 * q["p25"]
    ratio = values.agg(F.avg(((F.col("v") < low) | (F.col("v") > high)).cast("double")).alias("ratio"))
    return ratio.filter(F.col("ratio") > OUTLIER_SHARE).select(
        *as_warning("target_outliers", "warning", F.lit(target),
                    F.format_string("%.2f%% of the target lies outside the fences.", F.col("ratio") * 100.0),
                    "Prefer robust models or transform the target.")
    )


def _certain(statistic: Column, p: Column) -> Column:
    """A fit without any rest has an infinite statistic and the p-value 0."""
    return F.when(F.abs(statistic) == INFINITE, F.lit(0.0)).otherwise(p)


def simple_regressions(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Slope test of the target on each numeric feature; all features share one aggregate.

    A feature without variation leaves a one-column design: its test is that of the target mean.
    """
    if not features:
        return df.sparkSession.createDataFrame([], TEST_SCHEMA)
    y, aggregates = c(target), []
    for i, name in enumerate(features):
        x = present(df, name).cast("double")
        both_y, both_x = F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)
        aggregates += [
            F.count(both_x).alias(f"n{i}"), correlation(x, y).alias(f"r{i}"),
            (F.min(both_x) == F.max(both_x)).alias(f"flat{i}"), F.signum(F.min(both_x)).alias(f"sign{i}"),
            F.avg(both_y).alias(f"mean{i}"), F.stddev_samp(both_y).alias(f"std{i}"),
        ]
    row = df.agg(*aggregates)
    structs = []
    for i, name in enumerate(features):
        n, r = F.col(f"n{i}"), F.col(f"r{i}")
        flat, sign = F.col(f"flat{i}"), F.col(f"sign{i}")
        rest = 1.0 - r * r
        slope_t = F.when(rest <= EXACT_FIT, F.signum(r) * INFINITE).otherwise(r * F.sqrt(F.try_divide(n - 2.0, rest)))
        mean_t = F.when(sign != 0, sign * F.try_divide(F.col(f"mean{i}") * F.sqrt(n), F.col(f"std{i}")))
        enough = n >= 3
        structs.append(F.struct(
            F.lit(name).alias("feature"),
            F.when(enough & flat, mean_t).when(enough, slope_t).alias("statistic"),
            F.when(flat, n - 1.0).otherwise(n - 2.0).alias("dof"),
            F.when(enough & flat, F.lit(0.0)).when(enough, r * r).alias("effect_size"),
            n.alias("n"),
        ))
    return rows_of(row, structs).filter(F.col("n") > 0).select(
        "feature", F.lit("numeric").alias("feature_type"), F.lit("ols_numeric").alias("test_used"), "statistic",
        _certain(F.col("statistic"), t_p(F.col("statistic"), F.col("dof"))).alias("p_value"), "effect_size",
        F.lit(None).cast("bigint").alias("n_groups"), F.lit(None).cast("double").alias("kruskal_statistic"),
        F.lit(None).cast("double").alias("kruskal_p_value"), F.lit(None).cast("bigint").alias("small_groups"), "n",
    )


def group_tests(df: DataFrame, target: str, features: Sequence[str], small: bool | None = None) -> DataFrame:
    """One-way analysis of variance and rank test of the target over each categorical feature.

    Rows collapse once to ``(feature, level, value)`` counts. Both tests read that table: group
    moments for the variance ratio, tie-averaged ranks from the ordered values for the rank test.
    """
    if not features:
        return df.sparkSession.createDataFrame([], TEST_SCHEMA)
    centre = df.agg(F.avg(c(target)).alias("m")).first()["m"] or 0.0
    parts = [p for n in features for p in (F.lit(n), as_text(df, n))]
    rows = df.select(c(target).alias("y"), F.stack(F.lit(len(features)), *parts).alias("feature", "level"))
    cells = materialised(rows.filter("level IS NOT NULL AND y IS NOT NULL").groupBy("feature", "level", "y").agg(F.count("*").alias("w")))
    if small is None:
        small = is_small(cells)
    ordered = ordered_counts(cells, ["feature"], "y", weight="w", small=small)
    ranks = ordered.select(
        "feature", "y", (average_rank() - (F.col("total") + 1) / 2.0).alias("rank"), F.col("n").alias("ties")
    )
    placed = attach(cells, ranks, ["feature", "y"], "ties")
    w, z = F.col("w"), F.col("y") - F.lit(centre)
    groups = placed.groupBy("feature", "level").agg(
        F.sum(w).alias("n"), F.sum(w * z).alias("s"), F.sum(w * z * z).alias("ss"), F.sum(w * F.col("rank")).alias("ranks")
    )
    spread = ranks.groupBy("feature").agg(F.sum(F.col("ties") * F.col("rank") * F.col("rank")).alias("rank_spread"))
    sums = groups.groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between_raw"),
        F.sum(F.col("ranks") * F.col("ranks") / F.col("n")).alias("rank_between"),
        F.count_if(F.col("n") < SMALL_GROUP).alias("small_groups"),
    ).join(spread, "feature")
    mean_part = F.col("s") * F.col("s") / F.col("n")
    between, total = F.col("between_raw") - mean_part, F.col("ss") - mean_part
    dof1, dof2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    enough = F.col("k") >= 2
    within = total - between
    exact = (between > 0) & (within <= EXACT_FIT * total) & (dof2 > 0)
    ratio = F.when(exact, F.lit(INFINITE)).otherwise(F.try_divide(F.try_divide(between, dof1), F.try_divide(within, dof2)))
    h = F.try_divide(F.col("rank_between") * (F.col("n") - 1), F.col("rank_spread"))
    tested = sums.select(
        "feature", F.when(enough, ratio).alias("statistic"), dof1.alias("d1"), dof2.alias("d2"),
        F.when(enough, F.try_divide(between, total)).alias("effect_size"), F.col("k").alias("n_groups"),
        F.when(enough, h).alias("kruskal_statistic"), "small_groups", "n",
    )
    return tested.select(
        "feature", F.lit("categorical").alias("feature_type"), F.lit("anova_kruskal").alias("test_used"), "statistic",
        _certain(F.col("statistic"), f_p(F.col("statistic"), F.col("d1"), F.col("d2"))).alias("p_value"), "effect_size", "n_groups", "kruskal_statistic",
        chi2_p(F.col("kruskal_statistic"), F.col("d1")).alias("kruskal_p_value"), "small_groups", "n",
    )


def feature_tests(df: DataFrame, target: str) -> DataFrame:
    """Test of every feature against the target, strongest evidence first."""
    data = with_target(df, target)
    features = features_of(data, target)
    numeric = [n for n in features if is_numeric(data, n)]
    tests = simple_regressions(data, target, numeric).unionByName(
        group_tests(data, target, [n for n in features if n not in numeric])
    )
    return tests.orderBy(F.asc_nulls_last("p_value"), F.desc_nulls_last("effect_size"), "feature")


def by_effect(tests: DataFrame) -> DataFrame:
    return tests.orderBy(F.desc_nulls_last("effect_size"), "feature")


def test_warnings(tests: DataFrame) -> DataFrame:
    # One row per feature, computed once for all three warnings.
    tests, column = materialised(tests.select("feature", "feature_type", "n", "n_groups", "small_groups")), F.col("feature")
    few = tests.filter((F.col("feature_type") == "numeric") & (F.col("n") < 3)).select(
        *as_warning("too_few_rows", "warning", column, F.concat(column, F.lit(": too few rows for a slope test.")), "Collect more rows."))
    alone = tests.filter((F.col("feature_type") == "categorical") & (F.col("n_groups") < 2)).select(
        *as_warning("too_few_groups", "warning", column, F.concat(column, F.lit(": a group test needs two groups.")), "Regroup the labels."))
    thin = tests.filter((F.col("n_groups") >= 2) & (F.col("small_groups") > 0)).select(
        *as_warning("small_groups", "warning", column, F.format_string("%s: %d groups with fewer than five rows.", "feature", "small_groups"),
                    "Read the p-values with care."))
    return few.unionByName(alone).unionByName(thin)


def box_groups(df: DataFrame, target: str, tests: DataFrame | None = None) -> DataFrame:
    """Box statistics per level for the categorical features among the three strongest tests."""
    data = with_target(df, target)
    top = (tests if tests is not None else feature_tests(df, target)).limit(BOX_FEATURES).collect()
    names = [r["feature"] for r in top if r["feature_type"] == "categorical"]
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, `group` string, n bigint, p50 double")
    parts = [p for n in names for p in (F.lit(n), as_text(data, n))]
    rows = data.select(c(target).alias("v"), F.stack(F.lit(len(names)), *parts).alias("feature", "group"))
    return box_stats(rows.filter(F.col("group").isNotNull()), ["feature", "group"], "v")


# --- multiple regression -----------------------------------------------------------------------


@dataclass(frozen=True)
class Design:
    """Columns of the model matrix and the summed products of its rows."""

    names: tuple[str, ...]
    terms: dict[str, tuple[str, tuple[int, ...]]]
    gram: np.ndarray
    moment: np.ndarray
    y_square: float
    n: int
    shift: np.ndarray
    y_shift: float
    medians: dict[str, float]


@dataclass(frozen=True)
class Regression:
    summary: DataFrame
    coefficients: DataFrame
    terms: DataFrame
    conclusions: DataFrame
    warned: Callable[[], DataFrame]
    built: bool = field(default=False)

    @cached_property
    def warnings(self) -> DataFrame:
        """Looked for when they are read: the fences of the target need passes of their own."""
        return self.warned()


SUMMARY_SCHEMA = (
    "model_built boolean, n_obs bigint, n_features int, r_squared double, adj_r_squared double, f_statistic double, "
    "f_p_value double, aic double, bic double"
)
COEFFICIENT_SCHEMA = (
    "term string, estimate double, std_error double, t_value double, p_value double, ci_low double, ci_high double"
)
TERM_SCHEMA = (
    "feature string, feature_type string, df double, sum_sq double, mean_sq double, f_value double, p_value double, "
    "partial_eta_squared double"
)
CONCLUSION_SCHEMA = "conclusion string, flag boolean, detail string"


class DesignTooWide(ValueError):
    pass


def build_design(df: DataFrame, target: str, features: Sequence[str], max_columns: int = MAX_DESIGN) -> Design:
    """Summed products of the treatment-coded model matrix without building the matrix.

    Rows collapse per combination of labels to counts and sums; grouping sets over that table give
    every block. The label total is checked first, so at most ``max_columns`` squared sums come back.
    """
    numeric = [n for n in features if is_numeric(df, n)]
    labels = [n for n in features if n not in numeric]
    at = {n: f"g{i}" for i, n in enumerate(labels)}
    levels = _levels(df.select(*[F.coalesce(as_text(df, n), F.lit(MISSING_LABEL)).alias(k) for n, k in at.items()]), at, max_columns - len(numeric) - 1)
    medians = _design_medians(df, numeric)
    xs = [f"x{i}" for i in range(len(numeric))]
    filled = df.select(
        c(target).alias("y"),
        *[F.coalesce(present(df, n).cast("double"), F.lit(medians[n])).alias(x) for n, x in zip(numeric, xs)],
        *[F.coalesce(as_text(df, n), F.lit(MISSING_LABEL)).alias(at[n]) for n in labels],
    )
    row = filled.agg(F.avg("y").alias("y"), *[F.avg(x).alias(x) for x in xs]).first()
    shift, y_shift = [row[x] for x in xs], row["y"]
    centred = filled.select(
        (F.col("y") - F.lit(y_shift)).alias("y"),
        *[(F.col(x) - F.lit(m)).alias(x) for x, m in zip(xs, shift)], *at.values(),
    )
    sums = {"n": F.count("*"), "sy": F.sum("y"), "syy": F.sum(F.col("y") * F.col("y"))}
    for i, x in enumerate(xs):
        sums[f"s{i}"], sums[f"sy{i}"] = F.sum(x), F.sum(F.col(x) * F.col("y"))
        for j in range(i + 1):
            sums[f"s{i}_{j}"] = F.sum(F.col(x) * F.col(xs[j]))
    cells = centred.groupBy(*at.values()).agg(*[v.alias(k) for k, v in sums.items()])
    totals = [F.sum(k).alias(k) for k in sums]
    if labels:
        keys = [c(k) for k in at.values()]
        sets = [[]] + [[k] for k in keys] + [[a, b] for a, b in combinations(keys, 2)]
        blocks = cells.groupingSets(sets, *keys).agg(*totals).collect()
    else:
        blocks = cells.agg(*totals).collect()
    return _assemble(blocks, numeric, labels, at, levels, list(sums), np.array(shift, dtype=float), y_shift, medians)


def _levels(filled: DataFrame, at: dict[str, str], room: int) -> dict[str, list[str]]:
    """Sorted labels per feature, collected only once their total is known to fit."""
    if not at:
        return {}
    parts = [p for n, k in at.items() for p in (F.lit(n), F.col(k))]
    distinct = filled.select(F.stack(F.lit(len(at)), *parts).alias("feature", "level")).distinct()
    found = distinct.limit(room + len(at) + 1).collect()
    if len(found) > room + len(at):
        raise DesignTooWide(f"more than {room} model columns; group the labels of wide features first")
    return {n: sorted(r["level"] for r in found if r["feature"] == n) for n in at}


def _assemble(blocks, numeric, labels, at, levels, sum_names, shift, y_shift, medians) -> Design:
    names, terms = ["Intercept"], {}
    for i, n in enumerate(numeric):
        terms[n] = ("numeric", (len(names),))
        names.append(n)
    column = {}
    for n in labels:
        start = len(names)
        for level in levels[n][1:]:
            column[(n, level)] = len(names)
            names.append(f"{n}[{level}]")
        terms[n] = ("categorical", tuple(range(start, len(names))))
    size, p = len(names), len(numeric)
    gram, moment = np.zeros((size, size)), np.zeros(size)
    y_square, n_rows = 0.0, 0

    def put(i, j, value):
        gram[i, j] = gram[j, i] = value

    for row in blocks:
        keyed = [(n, row[at[n]]) for n in labels if row[at[n]] is not None]
        if not keyed:
            n_rows, y_square = int(row["n"]), row["syy"]
            put(0, 0, row["n"])
            moment[0] = row["sy"]
            for i in range(p):
                put(0, i + 1, row[f"s{i}"])
                moment[i + 1] = row[f"sy{i}"]
                for j in range(i + 1):
                    put(i + 1, j + 1, row[f"s{i}_{j}"])
            continue
        positions = [column.get(k) for k in keyed]
        if None in positions:
            continue
        if len(positions) == 1:
            at_column = positions[0]
            put(at_column, at_column, row["n"])
            put(0, at_column, row["n"])
            moment[at_column] = row["sy"]
            for i in range(p):
                put(i + 1, at_column, row[f"s{i}"])
        else:
            put(*positions, row["n"])
    return Design(tuple(names), terms, gram, moment, float(y_square), n_rows, shift, float(y_shift), medians)


def _solve(design: Design) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, unscaled covariance and rank; a deficient matrix gets the minimum-norm solution."""
    scale = np.sqrt(np.maximum(np.diag(design.gram), 1e-300))
    unit = design.gram / np.outer(scale, scale)
    spectrum = np.linalg.eigvalsh(unit)
    rank = int((spectrum > spectrum.max() * 1e-10).sum())
    if rank == len(scale):
        inverse = np.linalg.inv(unit) / np.outer(scale, scale)
        return inverse @ design.moment, inverse, rank
    # Undo the centring: the minimum-norm solution depends on the original columns.
    back = np.eye(len(scale))
    for i, mean in enumerate(design.shift):
        back[i + 1, 0] = mean
    moment = back @ (design.moment + design.gram[:, 0] * design.y_shift)
    gram = back @ design.gram @ back.T
    inverse = np.linalg.pinv(gram, rcond=1e-11, hermitian=True)
    return inverse @ moment, inverse, rank


def _number(value) -> float | None:
    return float(value) if value is not None and math.isfinite(value) else None


def _p_order(rows: list[tuple], position: int) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[position] is None, r[position] if r[position] is not None else 0.0, r[0]))


def fit(design: Design) -> tuple[tuple, list[tuple], list[tuple]]:
    """Summary, coefficient rows and type-II term rows, all from the summed products."""
    beta, inverse, rank = _solve(design)
    n, dof = design.n, design.n - rank
    total = design.y_square - design.moment[0] ** 2 / n
    explained = _explained(design)
    residual = max(total - explained, 0.0)
    sigma2 = residual / dof if dof > 0 else math.nan
    summary = _summary(n, len(design.terms), total, residual, rank, dof)
    return summary, _p_order(_coefficients(design.names[1:], beta[1:], inverse[1:, 1:], sigma2, dof), 4), _p_order(
        _term_rows(design.terms, beta, inverse, sigma2, dof, residual), 6)


def _summary(n: int, features: int, total: float, residual: float, rank: int, dof: int) -> tuple:
    sigma2, model_dof = residual / dof if dof > 0 else math.nan, rank - 1
    f_value = (total - residual) / model_dof / sigma2 if model_dof > 0 and sigma2 > 0 else None
    r2 = 1.0 - residual / total if total > 0 else None
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / dof if r2 is not None and dof > 0 else None
    loglik = -n / 2.0 * (math.log(2 * math.pi) + math.log(residual / n) + 1.0) if residual > 0 else None
    return (
        True, n, features, _number(r2), _number(adjusted), _number(f_value), f_tail(f_value, model_dof, dof),
        None if loglik is None else -2 * loglik + 2 * rank, None if loglik is None else -2 * loglik + math.log(n) * rank,
    )


def _coefficients(names, beta, inverse, sigma2: float, dof: int) -> list[tuple]:
    width = t_quantile(0.025, dof) if dof > 0 else math.nan
    coefficients = []
    for i, name in enumerate(names):
        error = math.sqrt(sigma2 * inverse[i, i]) if sigma2 >= 0 and inverse[i, i] > 0 else math.nan
        t = beta[i] / error if error > 0 else math.nan
        coefficients.append((
            name, _number(beta[i]), _number(error), _number(t), t_two_sided(_number(t), dof),
            _number(beta[i] - width * error), _number(beta[i] + width * error),
        ))
    return coefficients


def _term_rows(terms_of, beta, inverse, sigma2: float, dof: int, residual: float) -> list[tuple]:
    terms = []
    for feature, (kind, columns) in terms_of.items():
        index = list(columns)
        block = inverse[np.ix_(index, index)]
        tested = max(int(np.linalg.matrix_rank(block, tol=1e-10 * max(np.abs(block).max(), 1e-300))), 1)
        quadratic = float(beta[index] @ np.linalg.pinv(block, rcond=1e-10, hermitian=True) @ beta[index])
        f_term = quadratic / tested / sigma2 if sigma2 > 0 else None
        ss = quadratic * len(index) / tested
        terms.append((
            feature, kind, float(len(index)), _number(ss), _number(ss / len(index)), _number(f_term),
            f_tail(f_term, tested, dof), _number(ss / (ss + residual)) if ss + residual > 0 else None,
        ))
    return terms


def _by_width(data: DataFrame, features: Sequence[str], max_columns: int) -> list[tuple[str, int]]:
    """Label columns and their levels, widest first. Levels are counted, but for columns so wide that an estimate tells all that hangs on it."""
    labels = [n for n in features if not is_numeric(data, n)]
    if not labels:
        return []
    texts, widths = {n: F.coalesce(as_text(data, n), F.lit(MISSING_LABEL)) for n in labels}, {}
    if not is_small(data):
        guess = data.agg(*[F.approx_count_distinct(texts[n]) for n in labels]).first()
        widths = {n: d for n, d in zip(labels, guess) if d > SURELY_WIDE * max_columns}
    parts = [p for n in labels if n not in widths for p in (F.lit(n), texts[n])]
    if parts:
        distinct = data.select(F.stack(F.lit(len(parts) // 2), *parts).alias("feature", "level")).distinct()
        widths |= {r["feature"]: r["d"] for r in distinct.groupBy("feature").agg(F.count("*").alias("d")).collect()}
    return sorted(widths.items(), key=lambda w: (-w[1], w[0]))


def _design_medians(data: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    medians = {n: 0.0 for n in numeric}
    if numeric:
        found = quantiles(long_numbers(data, numeric), ["column"], "value", {"m": 0.5}, small=is_small(data))
        medians |= {r["column"]: float(r["m"] or 0.0) for r in found.collect()}
    return medians


def _design_columns(data: DataFrame, design: Design) -> list[Column]:
    """All model columns but the constant, centred as in ``design``."""
    found = []
    for feature, (kind, columns) in design.terms.items():
        if kind == "numeric":
            found.append(F.coalesce(present(data, feature).cast("double"), F.lit(design.medians[feature])) - F.lit(float(design.shift[columns[0] - 1])))
            continue
        label = F.coalesce(as_text(data, feature), F.lit(MISSING_LABEL))
        found += [(label == design.names[i][len(feature) + 1 : -1]).cast("double") for i in columns]
    return found


def _level_sums(data: DataFrame, target: str, wide: str, design: Design) -> DataFrame:
    """Per level of the wide column: rows, sum of the target, and sums of all other model columns, centred as in ``design``."""
    y = c(target) - F.lit(design.y_shift)
    sums = [F.sum(v) for v in _design_columns(data, design)]
    level = F.coalesce(as_text(data, wide), F.lit(MISSING_LABEL)).alias("level")
    others = F.array(*sums) if sums else F.array().cast("array<double>")
    return data.groupBy(level).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("sy"), others.alias("v"))


def _outer_products(batches):
    """Sums over the levels of one task: v v'/n, v sy/n and sy sy/n."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        n, sy = batch.column("n").to_numpy(), batch.column("sy").to_numpy()
        v = vectors_of(batch.column("v"), len(n))
        joined = np.column_stack([v, sy])
        part = (joined / n[:, None]).T @ joined
        total = part if total is None else total + part
    if total is not None:
        yield pa.record_batch({"sums": pa.array([total.tobytes()], pa.binary()), "levels": pa.array([0], pa.int64())})


def _products(sums: DataFrame, size: int) -> np.ndarray:
    """Sums over all levels of v v'/n, v sy/n and sy sy/n."""
    if size > FEW:
        found = sums.coalesce(16).mapInArrow(_outer_products, "sums binary, levels bigint").collect()
        return sum((np.frombuffer(r["sums"]) for r in found), np.zeros((size + 1) ** 2)).reshape(size + 1, size + 1)
    joined = [*[F.get("v", i) for i in range(size)], F.col("sy")]
    row = sums.agg(*[F.sum(a * b / F.col("n")) for a in joined for b in joined]).first()
    return np.array(row, float).reshape(size + 1, size + 1)


def _effects_of_levels(sums: DataFrame, beta: np.ndarray, inverse: np.ndarray, sigma2: float, first: tuple) -> DataFrame:
    """``level``, ``estimate`` and ``std_error`` against the first level, by expressions where the other columns are few."""
    if len(beta) > FEW:
        return sums.mapInArrow(_level_effects(beta, inverse, sigma2, first), "level string, estimate double, std_error double")
    n0, y0, v0 = first
    n, apart = F.col("n"), [F.get("v", i) / F.col("n") - F.lit(float(v) / n0) for i, v in enumerate(v0)]
    estimate, spread = F.col("sy") / n - F.lit(y0 / n0), 1.0 / n + F.lit(1.0 / n0)
    for i, a in enumerate(apart):
        estimate = estimate - a * F.lit(float(beta[i]))
        for j, b in enumerate(apart):
            spread = spread + a * b * F.lit(float(inverse[i, j]))
    return sums.select("level", estimate.alias("estimate"), F.sqrt(F.lit(float(sigma2)) * spread).alias("std_error"))


def _by_p_value(coefficients: DataFrame, dof: int) -> DataFrame:
    """Rows by p-value, then term. With one ``dof`` it falls with |t| until it is 0, so sorting doesn't compute it."""
    t = F.abs("t_value")
    key = F.when(t < INFINITE, F.least(t, F.lit(t_beyond(dof)))) if dof > 0 else F.lit(None).cast("double")
    return coefficients.orderBy(F.desc_nulls_last(key), "term")


def _level_effects(beta: np.ndarray, inverse: np.ndarray, sigma2: float, first: tuple):
    """Coefficient and error of each level against the first one."""
    n0, y0, v0 = first

    def run(batches):
        for batch in batches:
            n, sy = batch.column("n").to_numpy(), batch.column("sy").to_numpy()
            if not len(n):
                continue
            v = vectors_of(batch.column("v"), len(n))
            apart = v / n[:, None] - v0 / n0
            spread = 1 / n + 1 / n0 + ((apart @ inverse) * apart).sum(axis=1)
            yield pa.record_batch({
                "level": batch.column("level"), "estimate": pa.array(sy / n - y0 / n0 - apart @ beta), "std_error": pa.array(np.sqrt(sigma2 * spread)),
            })
    return run


def _fit_beside(data: DataFrame, target: str, used: Sequence[str], wide: str, max_columns: int) -> tuple[tuple, DataFrame, list[tuple]]:
    """The same least squares with the widest label column eliminated.

    Its block of the normal equations is diagonal, so sums per level give the equations of all
    other columns, which are solved here, and the level coefficients stay a distributed table. Alone, its
    coefficients are differences of group means. Where columns are
    collinear the coefficients are one of the solutions; the fit is the same.
    """
    others = [n for n in used if n != wide]
    design = build_design(data, target, others, max_columns)
    sums = materialised(_level_sums(data, target, wide, design))
    levels, size = sums.count(), len(design.names) - 1
    absorbed = _products(sums, size)
    beta, inverse, own_rank, residual = _beside(design, absorbed)
    rank = levels + own_rank
    total = design.y_square - design.moment[0] ** 2 / design.n
    dof = design.n - rank
    sigma2 = residual / dof if dof > 0 else math.nan
    summary = _summary(design.n, len(used), total, residual, rank, dof)
    terms = _term_rows({k: (kind, tuple(i - 1 for i in at)) for k, (kind, at) in design.terms.items()}, beta, inverse, sigma2, dof, residual)
    without, df = max(total - _explained(design) - residual, 0.0), float(levels - 1)
    f_wide = without / df / sigma2 if df > 0 and sigma2 > 0 else None
    terms.append((wide, "categorical", df, _number(without), _number(without / df) if df else None, _number(f_wide), f_tail(f_wide, df, dof),
                  _number(without / (without + residual)) if without + residual > 0 else None))
    first = sums.orderBy("level").first()
    effects = _effects_of_levels(sums.filter(F.col("level") != first["level"]), beta, inverse, sigma2, (first["n"], first["sy"], np.array(first["v"], float)))
    width, t = t_quantile(0.025, dof) if dof > 0 else math.nan, F.try_divide("estimate", "std_error")
    listed = effects.select(
        F.concat(F.lit(f"{wide}["), "level", F.lit("]")).alias("term"), "estimate", "std_error", t.alias("t_value"), t_p(t, F.lit(float(dof))).alias("p_value"),
        (F.col("estimate") - width * F.col("std_error")).alias("ci_low"), (F.col("estimate") + width * F.col("std_error")).alias("ci_high"))
    own = data.sparkSession.createDataFrame(_coefficients(design.names[1:], beta, inverse, sigma2, dof), COEFFICIENT_SCHEMA)
    return summary, _by_p_value(own.unionByName(listed), dof), _p_order(terms, 6)


def _beside(design: Design, absorbed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Coefficients, unscaled covariance, rank and residual of a design beside what other columns absorb of it and, last, of the target."""
    if len(design.names) == 1:
        return np.zeros(0), np.zeros((0, 0)), 0, max(design.y_square - absorbed[-1, -1], 0.0)
    schur, moment = design.gram[1:, 1:] - absorbed[:-1, :-1], design.moment[1:] - absorbed[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(design.gram)[1:], 1e-300))
    unit = schur / np.outer(scale, scale)
    inverse = np.linalg.pinv(unit, rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    beta = inverse @ moment
    residual = max(design.y_square - absorbed[-1, -1] - float(moment @ beta), 0.0)
    return beta, inverse, int(np.linalg.matrix_rank(unit, tol=1e-10, hermitian=True)), residual


def _fit_absorbed(data: DataFrame, target: str, used: Sequence[str], wide: Sequence[str], max_columns: int) -> tuple[tuple, DataFrame, list[tuple]]:
    """The same least squares beside several wide label columns.

    What they explain of every other model column and of the target is found over sums per level (``absorption``), so only the other columns'
    equations are solved here. Effects of wide levels are given against the first level; their errors aren't computed (null).
    """
    others = [n for n in used if n not in wide]
    design = build_design(data, target, others, max_columns)
    vectors = [*_design_columns(data, design), c(target) - F.lit(design.y_shift)]
    at = {w: f"w{i}" for i, w in enumerate(wide)}
    rows = data.select(*[F.coalesce(as_text(data, w), F.lit(MISSING_LABEL)).alias(k) for w, k in at.items()], *[v.alias(f"c{i}") for i, v in enumerate(vectors)])
    columns = [F.col(f"c{i}") for i in range(len(vectors))]
    whole = absorb(rows, list(at.values()), columns)
    beta, inverse, own_rank, residual = _beside(design, whole.products)
    rank = whole.rank + own_rank
    total, dof = design.y_square - design.moment[0] ** 2 / design.n, design.n - rank
    sigma2 = residual / dof if dof > 0 else math.nan
    terms = _term_rows({k: (kind, tuple(i - 1 for i in i_at)) for k, (kind, i_at) in design.terms.items()}, beta, inverse, sigma2, dof, residual)
    names = {k: w for w, k in at.items()}
    for key, rest in without_each(list(at.values())):
        less = whole.alone[rest[0]] if len(rest) == 1 else absorb(rows, rest, columns)
        _, _, less_rank, more = _beside(design, less.products)
        df, added = float(rank - less.rank - less_rank), max(more - residual, 0.0)
        f_term = added / df / sigma2 if df > 0 and sigma2 > 0 else None
        terms.append((names[key], "categorical", df, _number(added), _number(added / df) if df else None, _number(f_term), f_tail(f_term, df, dof),
                      _number(added / (added + residual)) if added + residual > 0 else None))
    effect = F.get("x", len(beta)) - sum((F.lit(float(v)) * F.get("x", i) for i, v in enumerate(beta)), F.lit(0.0))
    bases = [F.struct(F.lit(level).alias("level"), F.lit(float(x[-1] - x[:-1] @ beta)).alias("effect")) for level, x in whole.lowest]
    empty, levels = F.lit(None).cast("double"), whole.effects.select("axis", "level", effect.alias("effect"), F.get(F.array(*bases), F.col("axis")).alias("base"))
    listed = levels.filter("level <> base.level").select(
        F.concat(F.get(F.array(*[F.lit(w) for w in wide]), F.col("axis")), F.lit("["), "level", F.lit("]")).alias("term"),
        (F.col("effect") - F.col("base.effect")).alias("estimate"), *[empty.alias(n) for n in ("std_error", "t_value", "p_value", "ci_low", "ci_high")])
    own = data.sparkSession.createDataFrame(_coefficients(design.names[1:], beta, inverse, sigma2, dof), COEFFICIENT_SCHEMA)
    return (_summary(design.n, len(used), total, residual, rank, dof),
            own.unionByName(listed).orderBy(F.asc_nulls_last("p_value"), "term"), _p_order(terms, 6))


def fit_wide(data: DataFrame, target: str, used: Sequence[str], widths: Sequence[tuple[str, int]], max_columns: int) -> tuple[tuple, DataFrame, list[tuple]]:
    """Least squares with more levels than ``max_columns``: the widest label columns are absorbed until the others fit.

    The widest column always goes, a further one only with more than ``NARROW`` levels: steps over tables pay for wide columns
    alone. Narrow columns that don't fit ``max_columns`` together raise ``DesignTooWide``.
    """
    room, wide = max_columns - 1, []
    narrow = sum(d - 1 for _, d in widths) + len(used) - len(widths)
    for name, d in widths:
        if not wide or (narrow > room and d > NARROW):
            wide.append(name)
            narrow -= d - 1
    if not wide:
        raise DesignTooWide(f"more than {max_columns} numeric columns")
    if len(wide) == 1:
        return _fit_beside(data, target, used, wide[0], max_columns)
    # Vectors of all other columns go through every step, so wide company takes all but the narrowest with it.
    wide += [name for name, d in widths if name not in wide and d > NARROW]
    return _fit_absorbed(data, target, used, wide, max_columns)


def _explained(design: Design) -> float:
    """Explained sum of squares, the same for every solution of a deficient system."""
    n = design.gram[0, 0]
    inner = design.gram[1:, 1:] - np.outer(design.gram[1:, 0], design.gram[0, 1:]) / n
    right = design.moment[1:] - design.gram[1:, 0] * design.moment[0] / n
    scale = np.sqrt(np.maximum(np.diag(inner), 1e-300))
    unit = inner / np.outer(scale, scale)
    solved = np.linalg.pinv(unit, rcond=1e-10, hermitian=True) @ (right / scale)
    return float(solved @ (right / scale))


def _varying(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with different values. Most show them in a few rows; only the others are read in full."""
    values = df.select(*[present(df, n).alias(f"v{i}") for i, n in enumerate(features)])
    shown = [[v for v in column if v is not None] for column in zip(*values.limit(SHOWN).collect())]
    varies = {n: any(v != column[0] for v in column) for n, column in zip(features, shown)}
    if open_ := [i for i, n in enumerate(features) if not varies[n]]:
        row = values.agg(*[(F.min(f"v{i}") != F.max(f"v{i}")).alias(f"v{i}") for i in open_]).first()
        varies |= {features[i]: row[f"v{i}"] for i in open_}
    return [n for n in features if varies[n]]


def _unbuilt(df: DataFrame, warned: Callable[[], DataFrame]) -> Regression:
    spark = df.sparkSession
    summary = spark.createDataFrame([(False, 0, 0, None, None, None, None, None, None)], SUMMARY_SCHEMA)
    return Regression(
        summary, spark.createDataFrame([], COEFFICIENT_SCHEMA), spark.createDataFrame([], TERM_SCHEMA),
        spark.createDataFrame([], CONCLUSION_SCHEMA), warned,
    )


def multiple_regression(
    df: DataFrame, target: str, roles: Roles = Roles(), max_columns: int = MAX_DESIGN
) -> Regression:
    """Least squares of the target on every varying feature, with type-II terms."""
    if target not in df.columns:
        return _unbuilt(df, lambda: warning_rows(df, [("missing_target", "warning", target, f"{target} is not in the table.", "Load the departures extract.")]))
    data = with_target(df, target)
    if not data.take(1):
        return _unbuilt(df, lambda: warning_rows(df, [("target_all_missing", "warning", target, f"{target} has no numeric value.", "Clean the target.")]))
    warned = lambda: quality_warnings(data, roles).unionByName(target_outliers(data, target))
    features = features_of(data, target)
    if not features:
        return _unbuilt(df, lambda: warned().unionByName(warning_rows(df, [("no_features_available", "warning", None, "No predictors besides the target.", "Check the extract.")])))
    used = _varying(data, features)
    notes = [("feature_excluded_constant", "info", n, f"{n} does not vary and was left out.", "Use features that vary.") for n in features if n not in used]
    if not used:
        notes.append(("no_features_after_cleaning", "warning", None, "No predictor varies.", "Check the extract."))
        return _unbuilt(df, lambda: warned().unionByName(warning_rows(df, notes)))
    try:
        widths = _by_width(data, used, max_columns)
        if sum(d - 1 for _, d in widths) + len(used) - len(widths) < max_columns:
            summary, coefficients, terms = fit(build_design(data, target, used, max_columns))
            coefficients = df.sparkSession.createDataFrame(coefficients, COEFFICIENT_SCHEMA)
        else:
            summary, coefficients, terms = fit_wide(data, target, used, widths, max_columns)
    except (DesignTooWide, NotConverged, np.linalg.LinAlgError) as error:
        notes.append(("multiple_regression_fit_failed", "error", None, f"The model was not fitted: {error}.", "Group wide or collinear features."))
        return _unbuilt(df, lambda: warned().unionByName(warning_rows(df, notes)))
    if summary[1] < max(20, 3 * summary[2]):
        notes.append(("low_sample_for_multivariate_model", "warning", None, f"Only {summary[1]} rows for {summary[2]} features.", "Simplify the model."))
    spark = df.sparkSession
    strong = [t[0] for t in terms if t[6] is not None and t[6] < SIGNIFICANT][:TERMS_NAMED]
    conclusions = [
        ("global_significant", None if summary[6] is None else summary[6] < SIGNIFICANT, None),
        ("significant_terms", bool(strong), ", ".join(strong)),
    ]
    return Regression(
        spark.createDataFrame([summary], SUMMARY_SCHEMA), coefficients,
        spark.createDataFrame(terms, TERM_SCHEMA), spark.createDataFrame(conclusions, CONCLUSION_SCHEMA),
        lambda: warned().unionByName(warning_rows(df, notes)), True,
    )


def by_t_value(coefficients: DataFrame) -> DataFrame:
    return coefficients.orderBy(F.desc_nulls_last(F.abs("t_value")), "term")
