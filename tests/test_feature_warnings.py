"""Warnings of feature tests read the tests once."""

from __future__ import annotations

import pytest

from tidegauge.operators import inference as N


def test_warnings_read_a_kept_table_of_tests(spark):
    rows = [(f"g{i // 3}", "one", float(i % 7)) for i in range(60)]
    frame = spark.createDataFrame(rows, "g string, flat string, y double")
    found = N.test_warnings(N.group_tests(frame, "y", ["g", "flat"], small=True))
    assert {(r["code"], r["column"]) for r in found.collect()} == {("small_groups", "g"), ("too_few_groups", "flat")}
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert "Join" not in plan and "Window" not in plan


def test_rank_test_with_ties(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)]
    frame = spark.createDataFrame(rows, "g string, y double")
    found = N.group_tests(frame, "y", ["g"], small=False).first()
    ranks = {1.0: 1.0, 2.0: 3.0, 3.0: 5.0, 4.0: 6.0}
    sums = {g: sum(ranks[y] for k, y in rows if k == g) for g in "ab"}
    spread = sum((ranks[y] - 3.5) ** 2 for _, y in rows)
    assert found["kruskal_statistic"] == pytest.approx(5 * sum((s / 3 - 3.5) ** 2 * 3 for s in sums.values()) / spread)
