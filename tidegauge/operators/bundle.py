"""Whole-source bundles: every section of the exploratory report as flat tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import Roles, analytical_columns, c, is_technical
from tidegauge.operators import association, cluster, compare, impute, inference, profile, quality
from tidegauge.operators.models import Benchmark, Factory, best_run, compare_strategies, run_benchmark
from tidegauge.operators.overview import TargetOverview, target_overview
from tidegauge.operators.temporal import (
    DEFAULT_FAMILIES,
    Family,
    Segments,
    backoff,
    best_families,
    build_segments,
    data_warnings,
    heuristic_metrics,
    heuristic_table,
    prediction_table,
    segment_report,
    split_problems,
    split_summary,
    target_diagnostics,
    temporal_split,
    tier_usage,
    training_warnings,
)
from tidegauge.plans.counts import column_summary, value_counts
from tidegauge.sources.store import sample_rows

MOST_FACTS = 6
DICTIONARY_SCHEMA = "column string, logical_type string, description string, analytical_role string, notes string"


@dataclass(frozen=True)
class Exploration:
    global_metrics: DataFrame
    missingness: DataFrame
    cardinality: DataFrame
    top_values: DataFrame
    describe: DataFrame
    histogram: DataFrame
    warnings: DataFrame


def explore(df: DataFrame, roles: Roles = Roles()) -> Exploration:
    """Base exploration of the analytical columns; one value-count table feeds every frequency figure."""
    names = analytical_columns(df)
    counts = value_counts(df, names).persist()
    summary = profile.numeric_summary(df).persist()
    return Exploration(
        quality.global_metrics(df),
        quality.missingness(df, names),
        column_summary(counts).select("column", "distinct_values"),
        profile.top_categories(df, counts=counts),
        summary.filter("n > 0").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max"),
        profile.histogram(df, summary=summary),
        quality.quality_warnings(df, roles, counts).unionByName(quality.technical_notice(df)),
    )


def variable_dictionary(df: DataFrame, dictionary: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Documented and observed variables with their type, missing share and distinct values.

    Observed columns without an entry get the supporting role. ``summary`` holds the figures of every column, if known.
    """
    spark = df.sparkSession
    dictionary = dictionary if dictionary is not None else spark.createDataFrame([], DICTIONARY_SCHEMA)
    types = spark.createDataFrame(
        [(n, t, is_technical(n)) for n, t in df.dtypes], "column string, observed_type string, technical boolean")
    summary = (summary if summary is not None else column_summary(value_counts(df, df.columns))).select(
        "column", F.round(F.col("missing") / F.col("n_rows") * 100.0, 4).alias("missing_pct"), "distinct_values")
    joined = types.join(dictionary.withColumn("documented", F.lit(True)), "column", "left").join(summary, "column", "left")
    return joined.filter(F.col("documented") | ~F.col("technical")).select(
        "column", F.coalesce("logical_type", F.lit("observed")).alias("logical_type"), "observed_type", "description",
        F.coalesce("analytical_role", F.lit("apoyo")).alias("analytical_role"), "notes", "missing_pct", "distinct_values",
    ).orderBy("column")


@dataclass(frozen=True)
class SourceSection:
    """Audit, quality, univariate, bivariate and temporal tables of one source, each computed when it is first read.

    The raw table feeds the audit, the imputed one the statistics. Tables without a target or period are None.
    """

    raw: DataFrame
    analysis: DataFrame
    source: str
    roles: Roles = Roles()
    pipeline_warnings: DataFrame | None = None
    documented: DataFrame | None = None

    @property
    def target(self) -> str | None:
        return self.roles.target if self.roles.target in self.analysis.columns else None

    @cached_property
    def raw_counts(self) -> DataFrame:
        return value_counts(self.raw).persist()

    @cached_property
    def counts(self) -> DataFrame:
        """Counted once where the statistics read the raw table too."""
        return self.raw_counts if self.analysis is self.raw else value_counts(self.analysis).persist()

    @cached_property
    def column_figures(self) -> DataFrame:
        """Summary of every raw column. The values of technical ones, mostly keys, are counted but not kept."""
        own = column_summary(self.raw_counts)
        hidden = [n for n in self.raw.columns if is_technical(n)]
        return (own.unionByName(column_summary(value_counts(self.raw, hidden))) if hidden else own).persist()

    @cached_property
    def summary(self) -> DataFrame:
        return profile.numeric_summary(self.analysis).persist()

    @cached_property
    def tests(self) -> DataFrame | None:
        return inference.feature_tests(self.analysis, self.target).persist() if self.target else None

    @cached_property
    def overview(self) -> DataFrame:
        return quality.source_overview(self.raw)

    @cached_property
    def identifiers(self) -> DataFrame:
        return self.column_figures.filter(F.col("distinct_values") == F.col("n_rows")).select("column", "distinct_values")

    @cached_property
    def dictionary(self) -> DataFrame:
        return variable_dictionary(self.raw, self.documented, summary=self.column_figures)

    @cached_property
    def findings(self) -> DataFrame:
        return quality.quality_findings(self.raw, self.roles, self.raw_counts)

    @cached_property
    def numeric(self) -> DataFrame:
        spread = F.when(F.col("mean") != 0, F.try_divide(F.col("std"), F.col("mean")))
        return self.summary.filter(F.col("min") != F.col("max")).withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("coefficient_variation", spread)

    @cached_property
    def histogram(self) -> DataFrame:
        return profile.histogram(self.analysis, summary=self.summary)

    @cached_property
    def categorical(self) -> DataFrame:
        return profile.categorical_profile(self.analysis, self.counts)

    @cached_property
    def top_values(self) -> DataFrame:
        return profile.top_categories(self.analysis, counts=self.counts)

    @cached_property
    def correlations(self) -> DataFrame:
        return association.correlation_matrix(self.analysis)

    @cached_property
    def target_rankings(self) -> DataFrame | None:
        return association.target_rankings(self.analysis, self.target) if self.target else None

    @cached_property
    def group_tests(self) -> DataFrame | None:
        return self.tests.filter(F.col("feature_type") == "categorical") if self.target else None

    @cached_property
    def boxes(self) -> DataFrame | None:
        return inference.box_groups(self.analysis, self.target, self.tests) if self.target else None

    @cached_property
    def associations(self) -> DataFrame:
        return association.chi2_pairs(self.analysis, association.eligible_labels(self.analysis, self.counts)).persist()

    @cached_property
    def preview(self) -> DataFrame:
        return association.contingency_preview(self.analysis, self.associations)

    @cached_property
    def periods(self) -> DataFrame | None:
        return profile.period_counts(self.raw, self.roles.period) if self.roles.period in self.raw.columns else None

    @cached_property
    def sample(self) -> DataFrame:
        return sample_rows(self.raw, self.roles.key if self.roles.key in self.raw.columns else self.raw.columns[0])

    @cached_property
    def warnings(self) -> DataFrame:
        warned = quality.quality_warnings(self.raw, self.roles, self.raw_counts)
        if self.pipeline_warnings is not None:
            warned = warned.unionByName(quality.route_pipeline_warnings(self.pipeline_warnings, self.source))
        return quality.dedupe_warnings(warned)


def source_section(
    raw: DataFrame, analysis: DataFrame, source: str, roles: Roles = Roles(),
    pipeline_warnings: DataFrame | None = None, dictionary: DataFrame | None = None,
) -> SourceSection:
    """Section of one source; ``dictionary`` holds its documented variables."""
    return SourceSection(raw, analysis, source, roles, pipeline_warnings, dictionary)


@dataclass(frozen=True)
class Comparison:
    shared: tuple[str, ...]
    numeric: DataFrame
    categorical: DataFrame


def compare_sources(in_df: DataFrame, out_df: DataFrame) -> Comparison:
    shared = compare.shared_columns(in_df, out_df)
    counts = value_counts(in_df, shared).persist(), value_counts(out_df, shared).persist()
    numeric, categories = compare.split_shared(in_df, out_df, counts)
    return Comparison(
        tuple(shared), compare.compare_numeric(in_df, out_df, numeric),
        compare.compare_categories(in_df, out_df, categories, counts),
    )


@dataclass(frozen=True)
class Bundle:
    sections: Mapping[str, SourceSection]
    comparison: Comparison
    imputed: Mapping[str, DataFrame]
    imputation: Mapping[str, DataFrame]
    outliers: Mapping[str, tuple[DataFrame, DataFrame]]
    clusters: Mapping[str, cluster.Clustering]
    facts: DataFrame
    warnings: DataFrame


def build_bundle(
    in_df: DataFrame, out_df: DataFrame, roles: Roles = Roles(), pipeline_warnings: DataFrame | None = None,
    dictionary: DataFrame | None = None, clusters: Mapping[str, cluster.Clustering] | None = None,
) -> Bundle:
    """Everything the exploratory report shows for both sources; stored clusters are reused when given."""
    sources = {"in": in_df, "out": out_df}
    plans = {s: impute.imputation_plan(df, roles) for s, df in sources.items()}
    imputed = {s: impute.impute(df, roles, plans[s]) for s, df in sources.items()}
    reports = {s: impute.imputation_report(df, roles, plans[s]) for s, df in sources.items()}
    sections = {s: source_section(df, imputed[s], s, roles, pipeline_warnings, dictionary) for s, df in sources.items()}
    comparison = compare_sources(in_df, out_df)
    outliers = {s: impute.outlier_columns(df) for s, df in sources.items()}
    clusters = clusters or {s: cluster.cluster_source(imputed[s]) for s in sources}
    warnings = sections["in"].warnings
    for more in (sections["out"].warnings, clusters["in"].warnings, clusters["out"].warnings):
        warnings = warnings.unionByName(more)
    if pipeline_warnings is not None:
        warnings = warnings.unionByName(quality.global_pipeline_warnings(pipeline_warnings))
    facts = insight_facts(sections, comparison, plans, outliers, clusters, roles)
    return Bundle(sections, comparison, imputed, reports, outliers, clusters, facts, quality.dedupe_warnings(warnings))


def insight_facts(sections, comparison, plans, outliers, clusters, roles: Roles) -> DataFrame:
    """At most six ``(position, fact, evidence)`` rows: each rule turns the first row of a small table into evidence.

    A rule is a fact, a table (None: no table), and the text of its row. Facts stand in the order of the rules.
    """
    spark = sections["in"].overview.sparkSession
    tests, lead = sections["out"].group_tests, roles.categorical[0] if roles.categorical else ""
    filled = [row for plan in plans.values() for row in plan if row[4]]
    complete = spark.range(1) if not filled else None
    picked = {s: clusters[s].candidates.filter("selected") for s in ("in", "out")}
    structure = F.format_string("%d clusters, %.2f%% noise", "cluster_count", "noise_ratio")
    of_in = picked["in"].first()
    shown_out = of_in is None or of_in["cluster_count"] == 0
    rules = [
        ("nothing_imputed", complete, F.lit("both sources are complete")),
        ("groups_differ", None if tests is None else tests.filter(F.col("p_value") < inference.SIGNIFICANT).orderBy("p_value", F.desc("effect_size"), "feature"),
         F.concat("feature", F.lit(" (p="), F.format_string("%.3g", "p_value"), F.lit(")"))),
        ("dominant_condition", sections["in"].top_values.filter((F.col("column") == "Condition") & (F.col("rank") == 1)), F.format_string("%s (%.2f%%)", "value", "pct")),
        ("dominant_owner", comparison.categorical.filter((F.col("column") == lead) & (F.col("rank") == 1)), F.format_string("%s (%.2f%% in, %.2f%% out)", "category", "in_pct", "out_pct")),
        ("extreme_values", outliers["out"][1].filter("flagged_rows > 0"), F.format_string("%d rows (%.2f%%)", "flagged_rows", "flagged_ratio")),
        ("cluster_structure_in", picked["in"], structure),
        ("cluster_structure_out", picked["out"] if shown_out else None, structure),
    ]
    rows = [frame.limit(1).select(F.lit(i).alias("rule"), F.lit(fact).alias("fact"), text.alias("evidence")) for i, (fact, frame, text) in enumerate(rules) if frame is not None]
    found = sorted(tuple(r) for r in functools.reduce(DataFrame.unionByName, rows).collect())[:MOST_FACTS]
    return spark.createDataFrame([(i, fact, evidence) for i, (_, fact, evidence) in enumerate(found)], "position int, fact string, evidence string")


@dataclass(frozen=True)
class Evaluation:
    """Temporal evaluation together with the target overview, feature tests and regression."""

    split: DataFrame | None
    benchmark: DataFrame | None
    effects: DataFrame | None
    heuristics: DataFrame | None
    comparison: DataFrame | None
    diagnostics: DataFrame | None
    overview: TargetOverview
    tests: DataFrame | None
    regression: inference.Regression
    warnings: DataFrame
    tiers: DataFrame | None = None
    segments: DataFrame | None = None
    predictions: DataFrame | None = None


def best_beside(benchmark: Benchmark, segments: Segments) -> DataFrame:
    """Scored rows with the best learner's ``regression`` (the baseline where none was fitted), the ``heuristic`` and its tier."""
    best = best_run(benchmark)
    learned = c(best[2]) if best else F.lit(float(benchmark.baseline))
    simple, combined = best_families(heuristic_metrics(segments), segments.families)
    rows = backoff(benchmark.scored.withColumn("regression", learned), segments, simple, combined)
    return rows.withColumnRenamed("predicted", "heuristic")


def evaluate(
    df: DataFrame, roles: Roles = Roles(), families: tuple[Family, ...] = DEFAULT_FAMILIES,
    models: Mapping[str, Factory | None] | None = None,
) -> Evaluation:
    """Combined evaluation of one history table."""
    overview = target_overview(df, roles.target, roles)
    regression = inference.multiple_regression(df, roles.target, roles)
    tests = inference.feature_tests(df, roles.target) if overview.present else None
    warnings = overview.warnings.unionByName(regression.warnings)
    if tests is not None:
        warnings = warnings.unionByName(inference.test_warnings(tests))
    problems = split_problems(df, roles.target, roles.period)
    if problems.take(1):
        return Evaluation(None, None, None, None, None, None, overview, tests, regression, quality.dedupe_warnings(warnings.unionByName(problems)))
    split = temporal_split(df, roles.target, roles.period)
    segments = build_segments(split, families)
    benchmark = run_benchmark(split, models)
    both = best_beside(benchmark, segments)
    heuristics = heuristic_table(split, segments)
    for more in (training_warnings(split), data_warnings(split, roles), benchmark.warnings):
        warnings = warnings.unionByName(more)
    return Evaluation(
        split_summary(split), benchmark.rows, benchmark.effects, heuristics,
        compare_strategies(benchmark.rows.filter(F.col("strategy") != "baseline"), heuristics),
        target_diagnostics(split), overview, tests, regression, quality.dedupe_warnings(warnings),
        tier_usage(both), segment_report(split, segments, both), prediction_table(both, roles.key, roles.period, "heuristic"),
    )
