"""Wide label columns in several blocks: sums that move between blocks, rows that repeat, groups that nothing connects."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import absorption as A
from tidegauge.operators import inference as N
from tidegauge.operators import level_blocks as B


@pytest.fixture
def split(monkeypatch):
    """Blocks and packs of a few rows."""
    monkeypatch.setattr(B, "LEAST_ROWS", 150)
    monkeypatch.setattr(B, "PACKED_ROWS", 40)


def dense(rows, labels):
    return np.stack([[r[i] == v for r in rows] for i in range(labels) for v in sorted({r[i] for r in rows})], axis=1).astype(float)


@pytest.mark.parametrize("labels,levels", [(2, (40, 25)), (2, (6, 3)), (3, (30, 20, 12))])
def test_blocks_give_the_projection_and_the_effects(spark, split, labels, levels):
    rng = np.random.default_rng(sum(levels))
    rows = [(*[f"{k}{rng.integers(0, most)}" for k, most in zip("pqr", levels)], float(rng.normal()), float(rng.normal() + i % 3)) for i in range(700)]
    names = [f"w{i}" for i in range(labels)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", x double, y double")
    with B.laid_out(frame, names, ["x", "y"]) as blocks:
        assert len(blocks.keys) > 1 and blocks.cells.count() > 1
    found = A.absorb(frame, names, [F.col("x"), F.col("y")])
    x, v = dense(rows, labels), np.array([r[labels:] for r in rows])
    assert np.allclose(found.products, v.T @ x @ np.linalg.pinv(x.T @ x) @ x.T @ v, atol=1e-8)
    assert found.rank == np.linalg.matrix_rank(x)
    effects = {(r["axis"], r["level"]): r["x"] for r in found.effects.collect()}
    assert len(effects) == x.shape[1]
    fitted = np.array([sum(np.array(effects[i, r[i]]) for i in range(labels)) for r in rows])
    assert np.allclose(x.T @ (v - fitted), 0, atol=1e-6)
    for i, n in enumerate(names):
        lone = A.absorb(frame.select(n, "x", "y"), [n], [F.col("x"), F.col("y")])
        assert np.allclose(found.alone[n].products, lone.products) and found.alone[n].rank == lone.rank
        low, at = found.lowest[i]
        assert low == min(r[i] for r in rows) and list(at) == effects[i, low]


def test_groups_beyond_the_near_rounds_are_linked(spark, monkeypatch):
    monkeypatch.setattr(B, "LEAST_ROWS", 20)
    pairs = [(f"p{i}", f"q{i + j}") for i in range(60) for j in (0, 1)] + [("r", "s"), ("t", "u"), ("t", "v")]
    assert A.wide_rank(spark.createDataFrame(pairs, "w0 string, w1 string"), ["w0", "w1"]) == 62 + 64 - 3


def test_two_wide_columns_are_read_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"a{rng.integers(0, 40)}", f"b{rng.integers(0, 45)}", float(rng.normal())) for _ in range(800)]
    calls, real = [], N.absorb
    monkeypatch.setattr(N, "absorb", lambda *a: (calls.append(1), real(*a))[1])
    found = N.multiple_regression(spark.createDataFrame(rows, "a string, b string, y double"), "y", max_columns=20)
    assert len(calls) == 1 and {r["feature"]: r["df"] for r in found.terms.collect()} == {"a": 39.0, "b": 44.0}


def test_estimates_stand_in_for_levels_of_very_wide_columns_alone(spark, monkeypatch):
    frame = spark.range(3000).select(F.col("id").cast("string").alias("wide"), (F.col("id") % 1000).cast("string").alias("some"), (F.col("id") % 7).cast("string").alias("few"))
    monkeypatch.setattr(N, "is_small", lambda df: False)
    (first, guess), *rest = N._by_width(frame, ["few", "some", "wide"], 50)
    assert first == "wide" and guess == pytest.approx(3000, rel=0.2) and rest == [("some", 1000), ("few", 7)]


def test_columns_that_vary_late_or_not_at_all(spark):
    frame = spark.range(5000, numPartitions=1).select(
        F.lit("k").alias("same"), F.when(F.col("id") < 4990, "a").otherwise("b").alias("late"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("gaps"), F.col("id"))
    assert N._varying(frame, frame.columns) == ["late", "id"]
