"""How wide regressions run: few passes, few steps, no Python where nothing needs it."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidegauge.functions.tails import t_beyond, t_two_sided
from tidegauge.operators import inference as N


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    return calls


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{rng.integers(0, 40):02d}", f"b{rng.integers(0, 50):02d}", float(rng.normal()), float(rng.normal() + i % 5)) for i in range(800)]
    return spark.createDataFrame(rows, "a string, b string, x double, y double").persist()


def test_a_wide_regression_looks_for_its_medians_once(frame, monkeypatch):
    calls = counted(monkeypatch, N, "quantiles")
    found = N.multiple_regression(frame.select("a", "x", "y"), "y", max_columns=20)
    found.coefficients.collect()
    assert found.built and len(calls) == 1
    assert found.warnings.count() >= 0 and len(calls) > 1


@pytest.mark.parametrize("columns", [("a",), ("a", "x")])
def test_levels_beside_few_columns_need_no_python(frame, columns):
    found = N.multiple_regression(frame.select(*columns, "y"), "y", max_columns=20)
    plan = found.coefficients.select("term", "estimate", "std_error")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_numpy_and_expressions_agree(frame, monkeypatch):
    few = N.multiple_regression(frame.select("a", "x", "y"), "y", max_columns=20).coefficients.collect()
    monkeypatch.setattr(N, "FEW", 0)
    many = N.multiple_regression(frame.select("a", "x", "y"), "y", max_columns=20).coefficients.collect()
    assert [r["term"] for r in few] == [r["term"] for r in many]
    assert np.allclose([r[1:5] for r in few], [r[1:5] for r in many], rtol=1e-9)
    assert [r["term"] for r in few] == [r["term"] for r in sorted(few, key=lambda r: (r["p_value"], r["term"]))]


def test_certain_terms_are_ordered_by_name(spark):
    rows = [("z", 50.0, 0.1), ("b", -90.0, 0.1), ("c", 2.0, 0.1), ("d", None, None), ("a", 1.0, 0.1)]
    frame = spark.createDataFrame([(n, t, e) for n, t, e in rows], "term string, t_value double, std_error double")
    assert t_two_sided(t_beyond(10**6), 10**6) == 0.0 < t_two_sided(t_beyond(10**6) * 0.99, 10**6) and t_beyond(1) == math.inf
    assert [r["term"] for r in N._by_p_value(frame, 10**6).collect()] == ["b", "z", "c", "a", "d"]
