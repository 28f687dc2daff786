"""A section computes the tables that are read, and counts its columns once."""

from __future__ import annotations

import pytest

from tidegauge.functions.columns import Roles
from tidegauge.operators import association, bundle, inference, profile, quality
from tidegauge.plans.counts import column_summary, value_counts

ROLES = Roles(key="row_id", target="days", period="week", class_code="size", categorical=("kind",))


@pytest.fixture(scope="module")
def flow(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, "67"[i % 2], 1 + i % 2, float(i * i % 11)) for i in range(60)]
    return spark.createDataFrame(rows, "row_id int, kind string, size string, week int, days double").persist()


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    return calls


def test_unread_tables_run_nothing(flow, monkeypatch):
    steps = [counted(monkeypatch, m, n) for m, n in (
        (inference, "feature_tests"), (inference, "box_groups"), (profile, "histogram"), (association, "correlation_matrix"), (association, "eligible_labels"))]
    counts = counted(monkeypatch, bundle, "value_counts")
    found = bundle.source_section(flow, flow, "out", ROLES)
    assert {r["period"]: r["count"] for r in found.periods.collect()} == {"1": 30, "2": 30}
    assert [r["column"] for r in found.identifiers.collect()] == ["row_id"]
    assert {r["column"]: r["total_categories"] for r in found.categorical.collect()} == {"kind": 3, "size": 2}
    assert found.top_values.count() == 5
    assert not any(steps) and len(counts) == 2  # the columns of the statistics, and the key
    assert found.boxes.count() > 0 and found.group_tests.count() == 2 and [len(s) for s in steps[:2]] == [1, 1]


def test_all_tables_are_those_of_their_operators(flow):
    filled = flow.fillna("a", ["kind"])
    found = bundle.source_section(flow, filled, "out", ROLES)
    summary = column_summary(value_counts(flow, flow.columns))
    tests = inference.feature_tests(filled, "days")
    want = {
        "overview": quality.source_overview(flow),
        "identifiers": summary.filter("distinct_values = n_rows").select("column", "distinct_values"),
        "dictionary": bundle.variable_dictionary(flow),
        "findings": quality.quality_findings(flow, ROLES),
        "histogram": profile.histogram(filled),
        "categorical": profile.categorical_profile(filled),
        "top_values": profile.top_categories(filled),
        "correlations": association.correlation_matrix(filled),
        "target_rankings": association.target_rankings(filled, "days"),
        "group_tests": tests.filter("feature_type = 'categorical'"),
        "boxes": inference.box_groups(filled, "days"),
        "associations": association.chi2_pairs(filled),
        "preview": association.contingency_preview(filled),
        "periods": profile.period_counts(flow, "week"),
        "warnings": quality.dedupe_warnings(quality.quality_warnings(flow, ROLES)),
    }
    short = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    for name, table in want.items():
        assert short(getattr(found, name)) == short(table), name
    assert found.numeric.count() == 2 and found.sample.count() == 8
    bare = bundle.source_section(flow.select("kind"), flow.select("kind"), "in", ROLES)
    assert bare.boxes is None and bare.group_tests is None and bare.target_rankings is None and bare.periods is None
