"""Reconciliation of the two flow tables on their technical key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import Roles, c
from tidegauge.operators.quality import empty_warnings, warning_rows


@dataclass(frozen=True)
class Merged:
    table: DataFrame
    report: DataFrame
    warnings: DataFrame
    conflicts: tuple[str, ...] = ()


def suffix_join(in_df: DataFrame, out_df: DataFrame, key: str) -> DataFrame:
    """Inner join on the key; shared columns keep both versions under ``_in`` and ``_out``.

    A plain equi join: the adaptive planner picks broadcast or sort-merge by measured size and
    splits a key that holds much of the data.
    """
    shared = [n for n in in_df.columns if n in out_df.columns and n != key]

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            *[(c(n).cast("string") if n == key else c(n)).alias(f"{n}{suffix}" if n in shared else n) for n in df.columns]
        )

    joined = renamed(in_df, "_in").join(renamed(out_df, "_out"), key, "inner")
    first = [n for n in joined.columns if n == key]
    return joined.select(*[c(n) for n in first + [n for n in joined.columns if n != key]])


def conflicting(joined: DataFrame, columns: list[str]) -> dict[str, int]:
    """Joined rows on which the two versions of a column differ as text, missing values being equal."""
    if not columns:
        return {}
    differs = [
        F.coalesce(F.sum((~c(f"{n}_in").cast("string").eqNullSafe(c(f"{n}_out").cast("string"))).cast("bigint")), F.lit(0))
        .alias(f"d{i}")
        for i, n in enumerate(columns)
    ]
    row = joined.agg(*differs).first()
    return {n: row[f"d{i}"] for i, n in enumerate(columns)}


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of one side whose key never occurs on the other. NULL keys match nothing and skip the join."""
    keys = right.filter(c(key).isNotNull()).select(c(key).cast("string").alias("__k")).distinct()
    known = left.filter(c(key).isNotNull()).join(keys, c(key).cast("string") == F.col("__k"), "left_anti")
    return known.unionByName(left.filter(c(key).isNull()))


def merge(in_df: DataFrame | None, out_df: DataFrame | None, roles: Roles = Roles()) -> Merged:
    """Canonical table: equal overlap columns appear once (at the end), differing ones keep both versions.

    With one side absent the other passes through; with both absent there is nothing to merge.
    """
    if in_df is None and out_df is None:
        raise ValueError("Merging needs at least one table")
    if in_df is None or out_df is None:
        only = in_df if in_df is not None else out_df
        report = only.agg(F.count("*").alias("merged_rows")).select(
            F.lit("passthrough").alias("mode"), "merged_rows", *[F.lit(None).cast("bigint").alias(n) for n in
            ("input_in_rows", "input_out_rows", "unmatched_in_rows", "unmatched_out_rows")])
        return Merged(only, report, empty_warnings(only))
    key = roles.key
    if key not in in_df.columns or key not in out_df.columns:
        raise ValueError(f"Merge key '{key}' is missing on one side")
    joined = suffix_join(in_df, out_df, key)
    overlap = [n for n in roles.overlap if n in in_df.columns and n in out_df.columns and n != key]
    compared = [c(n) for n in (key, *overlap)]
    differs = conflicting(suffix_join(in_df.select(compared), out_df.select(compared), key), overlap)
    same = [n for n in overlap if differs[n] == 0]
    conflicts = tuple(n for n in overlap if differs[n])
    folded = {f"{n}{suffix}" for n in same for suffix in ("_in", "_out")}
    table = joined.select(
        *[c(n) for n in joined.columns if n not in folded], *[c(f"{n}_in").alias(n) for n in same]
    )
    notes = []
    if conflicts:
        notes.append(("overlap_column_conflict", "info", None,
                      f"Columns differ between the two sides and keep their suffixes: {', '.join(conflicts)}.",
                      "Expected when the sides are different stages; read them separately."))
    return Merged(table, merge_report(in_df, out_df, key), warning_rows(table, notes), conflicts)


def merge_report(in_df: DataFrame, out_df: DataFrame, key: str) -> DataFrame:
    """Input, matched and unmatched row counts in one row, from one count per key and side."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(c(key).cast("string").alias("key")).agg(F.count("*").alias(name))

    met = counted(in_df, "n_in").join(counted(out_df, "n_out"), "key", "full_outer")

    def total(value: str) -> Column:
        return F.coalesce(F.sum(F.expr(value)), F.lit(0))

    return met.agg(
        total("n_in").alias("input_in_rows"), total("n_out").alias("input_out_rows"), total("n_in * n_out").alias("merged_rows"),
        total("if(n_out IS NULL, n_in, 0)").alias("unmatched_in_rows"), total("if(n_in IS NULL, n_out, 0)").alias("unmatched_out_rows"),
    ).select(F.lit("merged").alias("mode"), "*")
