"""Regression over wide label columns against dense least squares."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import inference as N
from tidegauge.operators.absorption import absorb, wide_rank


def dense(rows, numbers, labels, target="y"):
    """Residual, rank and coefficients of the treatment-coded design."""
    columns, names = [np.ones(len(rows))], ["Intercept"]
    for n in numbers:
        columns.append(np.array([r[n] for r in rows], float))
        names.append(n)
    for n in labels:
        values = sorted({r[n] for r in rows})
        columns += [np.array([r[n] == v for r in rows], float) for v in values[1:]]
        names += [f"{n}[{v}]" for v in values[1:]]
    x, y = np.stack(columns, axis=1), np.array([r[target] for r in rows], float)
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum()), int(rank), dict(zip(names, beta))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(900):
        a, b, c, kind = rng.integers(0, 40), rng.integers(0, 45), rng.integers(0, 3), "uv"[rng.integers(0, 2)]
        x = rng.normal() + a / 20
        out.append({"a": f"a{a:02d}", "b": f"b{b:02d}", "c": f"c{c}", "kind": kind, "x": float(x), "y": float(2 * x + a % 7 + b % 5 + (kind == "v") + rng.normal())})
    return out


def fitted(spark, rows, columns, most):
    frame = spark.createDataFrame([{k: r[k] for k in (*columns, "y")} for r in rows])
    found = N.multiple_regression(frame, "y", max_columns=most)
    assert found.built
    return found.summary.first(), {r["term"]: r for r in found.coefficients.collect()}, {r["feature"]: r for r in found.terms.collect()}


@pytest.mark.parametrize("columns", [("a", "b", "x", "kind"), ("a", "b", "c")])
def test_two_wide_columns_match_dense_least_squares(spark, rows, columns):
    numbers, labels = [n for n in columns if n == "x"], [n for n in columns if n != "x"]
    summary, coefficients, terms = fitted(spark, rows, columns, 20)
    residual, rank, beta = dense(rows, numbers, labels)
    y = np.array([r["y"] for r in rows])
    assert summary["r_squared"] == pytest.approx(1 - residual / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    assert set(coefficients) == set(beta) - {"Intercept"}
    for name, value in beta.items():
        assert name == "Intercept" or coefficients[name]["estimate"] == pytest.approx(value, abs=1e-6)
    sigma2 = residual / (len(rows) - rank)
    for n in columns:
        less, less_rank, _ = dense(rows, [m for m in numbers if m != n], [m for m in labels if m != n])
        assert terms[n]["f_value"] == pytest.approx((less - residual) / (rank - less_rank) / sigma2, rel=1e-6)
    narrow = [n for n in coefficients if n == "x" or n.startswith(("kind", "c["))]
    assert all(coefficients[n]["std_error"] > 0 for n in narrow)
    if "x" in columns:
        assert (coefficients["x"]["estimate"] / coefficients["x"]["std_error"]) ** 2 == pytest.approx(terms["x"]["f_value"], rel=1e-6)


def test_a_lone_wide_column_is_group_means(spark, rows):
    summary, coefficients, terms = fitted(spark, rows, ("a",), 20)
    residual, rank, beta = dense(rows, [], ["a"])
    assert {k: r["estimate"] for k, r in coefficients.items()} == pytest.approx({k: v for k, v in beta.items() if k != "Intercept"})
    sigma2, sizes = residual / (len(rows) - rank), {}
    for r in rows:
        sizes[r["a"]] = sizes.get(r["a"], 0) + 1
    base = min(sizes)
    for level, size in sizes.items():
        if level != base:
            assert coefficients[f"a[{level}]"]["std_error"] == pytest.approx(np.sqrt(sigma2 * (1 / size + 1 / sizes[base])))
    assert terms["a"]["df"] == rank - 1


def test_rank_counts_groups_that_no_row_connects(spark):
    pairs = [("p", "1"), ("q", "1"), ("r", "2"), ("s", "3"), ("s", "4")]
    frame = spark.createDataFrame(pairs * 2, "w0 string, w1 string").withColumn("n", F.lit(1))
    assert wide_rank(frame, ["w0", "w1"]) == 4 + 4 - 3


def test_effects_reproduce_what_is_absorbed(spark):
    rng = np.random.default_rng(2)
    data = [(f"{rng.integers(0, 9)}", f"{rng.integers(0, 7)}", f"{rng.integers(0, 5)}", float(rng.normal()), 1.0) for _ in range(300)]
    frame = spark.createDataFrame(data, "w0 string, w1 string, w2 string, v double, one double")
    found = absorb(frame, ["w0", "w1", "w2"], [F.col("v"), F.col("one")])
    x = np.stack([[r[k] == str(i) for r in data] for k, size in ((0, 9), (1, 7), (2, 5)) for i in range(size)], axis=1).astype(float)
    v = np.array([(r[3], r[4]) for r in data])
    want = v.T @ x @ np.linalg.pinv(x.T @ x) @ x.T @ v
    assert np.allclose(found.products, want, atol=1e-8) and found.rank == np.linalg.matrix_rank(x)
