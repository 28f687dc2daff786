"""Type inference for all-text tables: one profiling action, then a lazy projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import Roles, as_number, c, is_numeric, to_number
from tidegauge.operators.quality import warning_rows

# Fixed values of the class-code and period rules.
CLASS_CODES = (1, 2, 20, 40, 45)
PARSE_SHARE = 0.9
CLASS_VALUES, CLASS_SHARE = 12, 0.1
PERIOD_VALUES, PERIOD_SHARE = 53, 0.1
BLANK_TEXTS = ("", "nan", "None")


def normalise_text(df: DataFrame) -> DataFrame:
    """Trim text cells; blank texts become NULL."""
    def cell(name: str) -> Column:
        if dict(df.dtypes)[name] != "string":
            return c(name)
        text = F.trim(c(name))
        return F.when(~text.isin(*BLANK_TEXTS), text).alias(name)

    return df.select(*[cell(n) for n in df.columns])


def _facts(df: DataFrame, names: list[str]) -> dict:
    aggregates = [F.count("*").alias("n")]
    for i, name in enumerate(names):
        number = as_number(df, name)
        aggregates += [
            F.count(number).alias(f"parsed{i}"),
            F.count_distinct(number).alias(f"distinct{i}"),
            F.coalesce(F.every(number.isin(*[float(v) for v in CLASS_CODES]) | number.isNull()), F.lit(True)).alias(f"codes{i}"),
            F.coalesce(F.every((F.abs(number % 1) < 1e-9) | number.isNull()), F.lit(True)).alias(f"whole{i}"),
        ]
    row = df.agg(*aggregates).first()
    return {
        name: {"n": row["n"], **{k: row[f"{k}{i}"] for k in ("parsed", "distinct", "codes", "whole")}}
        for i, name in enumerate(names)
    }


def behaves_like_codes(fact: dict) -> bool:
    """Known code sets, or few whole-number values, are classes rather than magnitudes."""
    if fact["parsed"] == 0 or fact["codes"]:
        return True
    few = fact["distinct"] <= CLASS_VALUES and fact["distinct"] / max(fact["n"], 1) <= CLASS_SHARE
    return fact["whole"] and few


def cast_types(df: DataFrame, source: str, roles: Roles = Roles()) -> tuple[DataFrame, DataFrame]:
    """Typed table with semantic types in the column metadata, and the typing warnings."""
    df = normalise_text(df)
    probed = [n for n in (roles.class_code, roles.period) if n in df.columns]
    facts = _facts(df, probed) if probed else {}
    notes, typed = [], []
    for name in df.columns:
        value, kind = c(name), "numeric" if is_numeric(df, name) else "categorical"
        if name in roles.categorical and name != roles.class_code:
            value, kind = c(name).cast("string"), "categorical"
        elif name == roles.target:
            value, kind = as_number(df, name), "numeric_target"
        elif name == roles.class_code:
            value, kind, note = _class_code(df, name, facts[name], source)
            notes += note
        elif name == roles.period:
            value, kind = _period(df, name, facts[name])
        typed.append(value.alias(name, metadata={"semantic_type": kind}))
    return df.select(*typed), warning_rows(df, notes)


def _class_code(df: DataFrame, name: str, fact: dict, source: str) -> tuple[Column, str, list[tuple]]:
    share = fact["parsed"] / fact["n"] if fact["n"] else 0.0
    if share < PARSE_SHARE:
        note = ("size_casted_to_categorical", "warning", name,
                f"{name} in {source} parses as a number in under 90% of rows; kept as text.",
                "Clean the values or unify the unit.")
        return c(name).cast("string"), "categorical", [note]
    if behaves_like_codes(fact):
        note = ("size_casted_to_categorical_discrete", "info", name,
                f"{name} in {source} holds few class codes; treated as categories.",
                "Compare classes instead of fitting a slope.")
        return as_number(df, name).cast("bigint").cast("string"), "categorical_discrete", [note]
    return as_number(df, name), "numeric", []


def _period(df: DataFrame, name: str, fact: dict) -> tuple[Column, str]:
    n = max(fact["n"], 1)
    if fact["parsed"] / n < PARSE_SHARE:
        return c(name).cast("string"), "categorical"
    few = fact["distinct"] <= PERIOD_VALUES and fact["distinct"] / n < PERIOD_SHARE
    return as_number(df, name), "discrete_numeric" if few else "numeric"


def semantic_types(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.metadata.get("semantic_type") or ("numeric" if is_numeric(df, f.name) else "categorical")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, semantic_type string")


def expected_columns(df: DataFrame, source: str, roles: Roles = Roles()) -> DataFrame:
    """Warning for columns the source should have."""
    missing = [n for n in roles.expected.get(source, ()) if n not in df.columns]
    if not missing:
        return warning_rows(df, [])
    return warning_rows(df, [(
        f"missing_expected_columns_{source}", "warning", None,
        f"{source}_file lacks expected columns: {', '.join(missing)}", "Check the extract or map its columns.")])
