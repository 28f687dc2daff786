"""How wide label columns are absorbed: few steps, and components of few links."""


from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import absorption as A


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    return calls


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{rng.integers(0, 40):02d}", f"b{rng.integers(0, 50):02d}", float(rng.normal()), float(rng.normal() + i % 5)) for i in range(800)]
    return spark.createDataFrame(rows, "a string, b string, x double, y double").persist()


def test_a_lone_column_is_absorbed_without_steps(frame, monkeypatch):
    calls = counted(monkeypatch, A, "_written")
    found = A.absorb(frame.select("a", "y"), ["a"], [F.col("y")])
    assert not calls and found.rank == 40
    sums = {}
    for r in frame.collect():
        sums.setdefault(r["a"], []).append(r["y"])
    assert found.products[0, 0] == pytest.approx(sum(sum(v) ** 2 / len(v) for v in sums.values()))


def test_the_widest_column_is_eliminated(frame, monkeypatch):
    calls = counted(monkeypatch, A, "_written")
    found = A.absorb(frame.selectExpr("b AS w0", "a AS w1", "x", "y"), ["w0", "w1"], [F.col("y"), F.col("x")])
    rows = frame.collect()
    design = np.stack([[r["b"] == v for r in rows] for v in sorted({r["b"] for r in rows})] + [[r["a"] == v for r in rows] for v in sorted({r["a"] for r in rows})], axis=1).astype(float)
    v = np.array([(r["y"], r["x"]) for r in rows])
    assert np.allclose(found.products, v.T @ design @ np.linalg.pinv(design.T @ design) @ design.T @ v, atol=1e-8)
    assert found.rank == np.linalg.matrix_rank(design) and len(calls) <= 13


def test_groups_of_a_long_chain_are_counted(spark):
    pairs = [(f"p{i}", f"q{i + j}") for i in range(30) for j in (0, 1)] + [("r", "s"), ("t", "u"), ("t", "v")]
    cells = spark.createDataFrame(pairs, "w0 string, w1 string").withColumn("n", F.lit(1))
    assert A.linked_groups(cells, cells, "w0", "w1") == 3
