"""Pivot metadata, the cluster view and stored tables on small frames."""

from __future__ import annotations

import pytest

from tidegauge.functions.columns import Roles
from tidegauge.operators.cluster import NOISE, cluster_view
from tidegauge.operators.inference import multiple_regression
from tidegauge.operators.pivot import pivot_metadata
from tidegauge.sources import store

ROLES = Roles(key="id", target="days", period="week", class_code="size", categorical=("kind",))


@pytest.fixture(scope="module")
def flow(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, "6" if i % 3 else "7", 1 + i % 2, float(i % 5)) for i in range(40)]
    return spark.createDataFrame(rows, "id int, kind string, size string, week int, days double")


def test_metadata_has_every_section(flow):
    rows = [r.asDict() for r in pivot_metadata(flow.drop("id"), "out", ROLES).collect()]
    by = lambda section: [r for r in rows if r["section"] == section]
    assert {r["field"]: r["value"] for r in by("default")} == {
        "row_dim": "kind", "col_dim": "size", "value_field": "days", "agg_func": "mean", "include_blank": "true", "top_k": "10", "small_n_threshold": "5"}
    assert [r["value"] for r in sorted(by("aggregate"), key=lambda r: r["position"]) if r["field"] == "kind"] == ["count"]
    assert len([r for r in by("aggregate") if r["field"] == "days"]) == 7
    assert [r["value"] for r in sorted(by("option"), key=lambda r: r["position"]) if r["field"] == "kind"] == ["a", "b", "(en blanco)"]
    assert not [r for r in by("option") if r["detail"]]


def test_view_warns_where_points_coincide(spark):
    rows = [(i, float(i % 4), i // 20) for i in range(40)]
    found = cluster_view(spark.createDataFrame(rows, "id int, x double, cluster int"), ["x"])
    assert found.overlap.first()["unique_coordinates"] == 4 and found.explained == pytest.approx(1.0)
    assert [r["code"] for r in found.warnings.collect()] == ["projection_high_overlap"]
    points = found.points.collect()
    assert {r["cluster_label"] for r in points} == {"cluster_0", "cluster_1"} and {r["display_weight"] for r in points} == {10}


def test_view_without_features(spark):
    empty = spark.createDataFrame([], "id int, cluster int")
    found = cluster_view(empty, [])
    assert found.points.count() == 0 and found.overlap.first()["n_rows"] == 0 and found.warnings.count() == 0
    lone = cluster_view(spark.createDataFrame([(1, NOISE)], "id int, cluster int"), [])
    assert lone.points.first()["cluster_label"] == "noise"


def test_analysis_round_trip(spark, flow, tmp_path):
    report = spark.createDataFrame([("kind", 6)], "column string, imputed int")
    store.save_analysis(flow, report, f"file://{tmp_path}/analysis", "week")
    rows, kept = store.load_analysis(spark, f"file://{tmp_path}/analysis")
    assert {tuple(r) for r in rows.select(*flow.columns).collect()} == {tuple(r) for r in flow.collect()}
    assert kept.first()["imputed"] == 6


def test_narrow_labels_beyond_the_limit_are_refused(spark):
    rows = [(f"a{i % 9}", f"b{i % 7}", f"c{i % 5}", float(i * i % 11)) for i in range(200)]
    frame = spark.createDataFrame(rows, "a string, b string, c string, y double")
    refused = multiple_regression(frame, "y", max_columns=6)
    assert not refused.built and "multiple_regression_fit_failed" in {r["code"] for r in refused.warnings.collect()}
    assert multiple_regression(frame, "y", max_columns=11).built
