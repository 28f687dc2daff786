"""From two delimited extracts to the canonical table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tidegauge.functions.columns import Roles
from tidegauge.operators.clean import clean
from tidegauge.operators.merge import merge
from tidegauge.operators.quality import missing_warnings, missingness
from tidegauge.operators.typing import cast_types, expected_columns, semantic_types
from tidegauge.plans.steps import Flow, Step, run_steps
from tidegauge.sources.delimited import read_delimited, read_report, sniff

SIDES = ("in", "out")


def load_source(spark: SparkSession, path: str, source: str, roles: Roles = Roles()) -> tuple[DataFrame, DataFrame]:
    """One extract read, cleaned and typed, with its warnings."""
    if source not in SIDES:
        raise ValueError("source must be 'in' or 'out'")
    cleaned, _, notes = clean(read_delimited(spark, path), f"{source}_file", roles)
    typed, more = cast_types(cleaned, f"{source}_file", roles)
    return typed, notes.unionByName(more)


def _each_side(flow: Flow, change) -> Flow:
    for side in SIDES:
        table = getattr(flow, f"{side}_df")
        if table is not None:
            flow = change(flow, side, table)
    return flow


def read_step(spark: SparkSession, in_path: str | None, out_path: str | None) -> Step:
    def run(flow: Flow) -> Flow:
        for side, path in zip(SIDES, (in_path, out_path)):
            if path is None:
                continue
            form = sniff(spark, path)
            table = read_delimited(spark, path, form)
            flow = replace(flow, **{f"{side}_df": table}).with_metadata(f"read_{side}", read_report(table, path, form))
        return flow

    return run


def clean_step(roles: Roles = Roles()) -> Step:
    def one(flow: Flow, side: str, table: DataFrame) -> Flow:
        cleaned, dropped, notes = clean(table, f"{side}_file", roles)
        flow = replace(flow, **{f"{side}_df": cleaned}).with_warnings(notes)
        return flow.with_metadata(f"dropped_{side}", dropped).with_warnings(expected_columns(cleaned, side, roles))

    return lambda flow: _each_side(flow, one)


def cast_step(roles: Roles = Roles()) -> Step:
    def one(flow: Flow, side: str, table: DataFrame) -> Flow:
        typed, notes = cast_types(table, f"{side}_file", roles)
        flow = replace(flow, **{f"{side}_df": typed}).with_warnings(notes)
        return flow.with_metadata(f"semantic_{side}", semantic_types(typed))

    return lambda flow: _each_side(flow, one)


def merge_step(roles: Roles = Roles()) -> Step:
    def run(flow: Flow) -> Flow:
        merged = merge(flow.in_df, flow.out_df, roles)
        flow = replace(flow, merged=merged.table).with_warnings(merged.warnings)
        return flow.with_metadata("merge", merged.report).with_metadata("conflicts", merged.conflicts)

    return run


def missing_step(flow: Flow) -> Flow:
    return flow.with_metadata("missing", missingness(flow.merged)).with_warnings(missing_warnings(flow.merged))


def ingest_steps(spark: SparkSession, in_path: str | None, out_path: str | None, roles: Roles = Roles()) -> list[Step]:
    return [read_step(spark, in_path, out_path), clean_step(roles), cast_step(roles), merge_step(roles), missing_step]


def ingest(
    spark: SparkSession,
    in_path: str | None = None,
    out_path: str | None = None,
    roles: Roles = Roles(),
    steps: Sequence[Step] | None = None,
) -> Flow:
    """Read, clean, type, merge and audit; ``steps`` replaces the default sequence."""
    return run_steps(Flow(), steps or ingest_steps(spark, in_path, out_path, roles))
