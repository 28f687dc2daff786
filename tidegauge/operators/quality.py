"""Data-quality audit: missingness, cardinality, warnings and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import (
    Roles,
    analytical_columns,
    c,
    is_numeric,
    is_technical,
    present,
    share,
)
from tidegauge.plans.counts import column_summary, ranked, value_counts
from tidegauge.plans.sizing import rows_of

WARNING_FIELDS = ("code", "severity", "column", "message", "suggestion")
WARNING_SCHEMA = "code string, severity string, column string, message string, suggestion string"

# Thresholds of the quality rules.
NEAR_CONSTANT_SHARE = 0.98
MANY_VALUES = 50
MANY_VALUES_RATIO = 0.30
RARE_SHARE = 0.01
RARE_LABELS_SHOWN = 5


def empty_warnings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], WARNING_SCHEMA)


def warning_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), WARNING_SCHEMA)


def as_warning(code: str, severity: str, column: Column, message: Column, suggestion: Column | str) -> list[Column]:
    hint = F.lit(suggestion) if isinstance(suggestion, str) else suggestion
    return [
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        column.cast("string").alias("column"),
        message.alias("message"),
        hint.alias("suggestion"),
    ]


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column from one map-side aggregate (no row is shuffled)."""
    names = list(columns) if columns is not None else df.columns
    counted = df.agg(
        F.count("*").alias("__n"), *[F.count(present(df, n)).alias(f"f{i}") for i, n in enumerate(names)]
    )
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            (F.col("__n") - F.col(f"f{i}")).alias("missing"),
            share(F.col("__n") - F.col(f"f{i}"), F.col("__n")).alias("missing_pct"),
        )
        for i, n in enumerate(names)
    ]
    return rows_of(counted, rows)


def missing_warnings(df: DataFrame) -> DataFrame:
    return (
        missingness(df)
        .filter(F.col("missing") > 0)
        .select(
            *as_warning(
                "missing_values_detected",
                "warning",
                F.col("column"),
                F.format_string("%s has %d missing values (%.2f%%).", "column", "missing", "missing_pct"),
                "Choose an imputation strategy before modelling.",
            )
        )
    )


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column; ``approximate`` trades exactness for a single small aggregate."""
    names = list(columns) if columns is not None else analytical_columns(df)
    if not approximate:
        return column_summary(value_counts(df, names)).select("column", "distinct_values")
    sketched = df.agg(*[F.approx_count_distinct(present(df, n)).alias(f"d{i}") for i, n in enumerate(names)])
    return rows_of(
        sketched,
        [F.struct(F.lit(n).alias("column"), F.col(f"d{i}").alias("distinct_values")) for i, n in enumerate(names)],
    )


def unique_identifiers(df: DataFrame) -> DataFrame:
    """Columns whose values are all present and all different."""
    summary = column_summary(value_counts(df, df.columns))
    return summary.filter(F.col("distinct_values") == F.col("n_rows")).select("column", "distinct_values")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*[present(df, n).alias(n) for n in df.columns]).agg(F.count("*").alias("__copies"))
    return groups.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"))


def type_counts(df: DataFrame) -> dict[str, int]:
    names = analytical_columns(df)
    numeric = sum(is_numeric(df, n) for n in names)
    return {
        "numeric": numeric,
        "categorical": len(names) - numeric,
        "technical_excluded": sum(is_technical(n) for n in df.columns),
    }


def global_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and type counts of the analytical columns."""
    names, kinds = analytical_columns(df), type_counts(df)
    missing = sum((F.count("*") - F.count(present(df, n)) for n in names), F.lit(0))
    cells = F.col("n_rows") * len(names)
    return df.agg(F.count("*").alias("n_rows"), missing.alias("missing_total")).select(
        "n_rows",
        F.lit(len(names)).alias("n_columns"),
        "missing_total",
        F.when(cells > 0, F.round(F.col("missing_total") / cells * 100.0, 4)).otherwise(0.0).alias("missing_pct_total"),
        F.lit(kinds["categorical"]).alias("categorical_columns"),
        F.lit(kinds["numeric"]).alias("numeric_columns"),
    )


def source_overview(df: DataFrame) -> DataFrame:
    """Shape, completeness, exact duplicates and type counts of a whole source.

    Equal rows collapse once; every figure is read from the collapsed table.
    """
    kinds, width = type_counts(df), len(df.columns)
    groups = df.groupBy(*[present(df, n).alias(n) for n in df.columns]).agg(F.count("*").alias("__copies"))
    empty_cells = sum((c(n).isNull().cast("bigint") for n in df.columns), F.lit(0))
    cells = F.col("n_rows") * width
    return groups.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(empty_cells * F.col("__copies")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
    ).select(
        "n_rows",
        F.lit(width).alias("n_columns"),
        "missing_cells",
        F.when(cells > 0, F.round((1 - F.col("missing_cells") / cells) * 100.0, 4)).otherwise(100.0).alias("completeness_pct"),
        "duplicate_rows",
        F.lit(kinds["numeric"]).alias("numeric_variables"),
        F.lit(kinds["categorical"]).alias("categorical_variables"),
    )


def profile_rows(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Column summaries for every requested column, also when the table is empty."""
    listed = df.sparkSession.createDataFrame(
        [(n, is_numeric(df, n)) for n in columns], "column string, numeric boolean"
    )
    summary = column_summary(counts if counts is not None else value_counts(df, columns))
    return listed.join(summary, "column", "left").na.fill(0)


def quality_warnings(df: DataFrame, roles: Roles = Roles(), counts: DataFrame | None = None) -> DataFrame:
    """Constant, near-constant and high-cardinality columns; a flat period gets its own warning."""
    names = analytical_columns(df)
    rows = profile_rows(df, names, counts)
    distinct, n = F.col("distinct_values"), F.greatest(F.col("n_rows"), F.lit(1))
    flat_period = (F.lower("column") == roles.period.lower()) & (distinct <= 1)
    top_share, ratio = F.col("top_count") / n, distinct / n
    owner = F.lower("column").startswith(roles.categorical[0].lower()) if roles.categorical else F.lit(False)
    constant = rows.filter((distinct <= 1) & ~flat_period).select(
        *as_warning(
            "constant_column", "warning", F.col("column"),
            F.format_string("%s is constant (%d distinct).", F.col("column"), distinct),
            "Leave constant columns out of models.",
        )
    )
    near = rows.filter((distinct > 1) & (top_share >= NEAR_CONSTANT_SHARE)).select(
        *as_warning(
            "near_constant_column", "warning", F.col("column"),
            F.format_string("%s is nearly constant (top value %.2f%%).", F.col("column"), top_share * 100.0),
            "Bin or drop the column when it adds little signal.",
        )
    )
    many = rows.filter(
        ~F.col("numeric") & (distinct > 1) & ((distinct > MANY_VALUES) | (ratio > MANY_VALUES_RATIO))
    ).select(
        *as_warning(
            "high_cardinality", "warning", F.col("column"),
            F.format_string("%s has many values (%d distinct, %.2f%% of rows).", F.col("column"), distinct, ratio * 100.0),
            F.when(owner, F.lit("Looks like an id: group it or use a per-group target mean."))
            .otherwise(F.lit("Keep the top labels and fold the rest.")),
        )
    )
    period = rows.filter((F.col("column") == roles.period) & (distinct <= 1)).select(
        *as_warning(
            "week_constant", "warning", F.col("column"),
            F.format_string("%s does not vary.", F.col("column")),
            "Read the period as context only.",
        )
    )
    return constant.unionByName(near).unionByName(many).unionByName(period)


def technical_notice(df: DataFrame) -> DataFrame:
    excluded = [n for n in df.columns if is_technical(n)]
    if not excluded:
        return empty_warnings(df)
    message = f"Technical columns left out of the statistics: {', '.join(excluded)}."
    return warning_rows(df, [("technical_columns_excluded", "info", None, message, "Id columns only serve joins.")])


def dedupe_warnings(warnings: DataFrame) -> DataFrame:
    """One row per code, column and message; the smallest severity and hint text stand for the rest."""
    return warnings.groupBy("code", "column", "message").agg(
        F.min(F.struct("severity", "suggestion")).alias("w")
    ).select("code", "w.severity", "column", "message", "w.suggestion")


def display_warnings(warnings: DataFrame) -> DataFrame:
    """Display form: equal texts once, all non-informative index notices as one row."""
    code = "custom_non_informative"
    rest = warnings.filter(F.col("code") != code).groupBy("code", "severity", "message", "suggestion").agg(
        F.min("column").alias("column")
    )
    notices = warnings.filter(F.col("code") == code).groupBy("code").agg(
        F.min("severity").alias("severity"), F.min("message").alias("message"), F.min("suggestion").alias("suggestion")
    ).withColumn("column", F.lit(None).cast("string"))
    return rest.unionByName(notices).select(*WARNING_FIELDS)


def normalise_warnings(warnings: DataFrame, df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Drop noise: technical columns, repeats of a flat period, cardinality of numbers; merge overlap conflicts."""
    technical = [n for n in df.columns if is_technical(n)]
    numeric = [n for n in df.columns if is_numeric(df, n)]
    column, code = F.col("column"), F.col("code")
    flat = warnings.filter(code == "week_constant").limit(1).select(F.lit(True).alias("__flat"))
    squeezed = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", ""))
    is_tech = squeezed.isin(*[n.lower().replace(" ", "") for n in technical]) | squeezed.startswith("unnamed:") \
        if technical else squeezed.startswith("unnamed:")
    kept = warnings.filter(~is_tech)
    conflicts = kept.filter((code == "overlap_column_conflict") & column.isNotNull())
    plain = kept.filter(code != "overlap_column_conflict")
    if numeric:
        plain = plain.filter(~((code == "high_cardinality") & F.coalesce(column.isin(*numeric), F.lit(False))))
    repeats = F.coalesce(column == roles.period, F.lit(False)) & code.isin("constant_column", "near_constant_column")
    plain = (
        plain.withColumn("__repeat", repeats)
        .join(F.broadcast(flat), F.col("__repeat") & F.col("__flat"), "left_anti")
        .drop("__repeat")
    )
    merged = conflicts.agg(F.array_sort(F.collect_set("column")).alias("names")).filter(F.size("names") > 0).select(
        *as_warning(
            "overlap_column_conflict", "info", F.lit(None),
            F.concat(F.lit("Columns differ between the two sides and keep their suffixes: "), F.array_join("names", ", "), F.lit(".")),
            "Expected when the sides are different stages; read them separately.",
        )
    )
    return plain.select(*WARNING_FIELDS).unionByName(merged)


def route_pipeline_warnings(warnings: DataFrame, source: str) -> DataFrame:
    """Ingest warnings that belong to one source."""
    typing = F.col("code").isin("size_casted_to_categorical", "size_casted_to_categorical_discrete")
    own = (F.col("code") == f"missing_expected_columns_{source}") | (typing & F.col("message").contains(f"{source}_file"))
    return dedupe_warnings(warnings.filter(own))


def global_pipeline_warnings(warnings: DataFrame) -> DataFrame:
    return dedupe_warnings(warnings.filter(F.col("code") == "overlap_column_conflict"))


def rare_categories(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Labels under one percent of all rows, the most frequent five per column."""
    names = [n for n in analytical_columns(df) if not is_numeric(df, n)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, n_rows bigint, rank int")
    if counts is None:
        counts = value_counts(df, names)
    counts = counts.filter(F.col("column").isin(*names))
    n_rows = column_summary(counts).select("column", "n_rows")
    rare = (
        counts.filter(F.col("value").isNotNull())
        .join(F.broadcast(n_rows), "column")
        .filter(F.col("n") / F.col("n_rows") < RARE_SHARE)
    )
    return ranked(rare, ["column"], [F.desc("n"), F.asc("value")], RARE_LABELS_SHOWN)


def quality_findings(df: DataFrame, roles: Roles = Roles(), counts: DataFrame | None = None) -> DataFrame:
    """Findings table: duplicates, missing cells, rare labels, high cardinality, limited variation."""
    if counts is None:
        counts = value_counts(df, analytical_columns(df))
    finding = ["kind", "severity", "column", "finding"]
    repeated = duplicate_rows(df).filter(F.col("duplicate_rows") > 0).select(
        F.lit("exact_duplicates").alias("kind"), F.lit("warning").alias("severity"),
        F.lit(None).cast("string").alias("column"),
        F.format_string("%d exact duplicate rows.", "duplicate_rows").alias("finding"),
    )
    missing = missing_warnings(df).select(
        F.lit("missing_values").alias("kind"), "severity", "column", F.col("message").alias("finding")
    )
    rare = rare_categories(df, counts).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("labels")
    ).select(
        F.lit("rare_categories").alias("kind"), F.lit("info").alias("severity"), "column",
        F.concat(F.col("column"), F.lit(" has marginal labels such as "), F.array_join("labels.value", ", "), F.lit(".")).alias("finding"),
    )
    flagged = quality_warnings(df, roles, counts).select(
        F.when(F.col("code") == "high_cardinality", F.lit("high_cardinality")).otherwise(F.lit("limited_variation")).alias("kind"),
        "severity", "column", F.col("message").alias("finding"),
    )
    return repeated.unionByName(missing).unionByName(rare).unionByName(flagged).dropDuplicates(["kind", "finding"]).select(*finding)
