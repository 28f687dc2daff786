"""Temporal holdout, heuristics and the model benchmark on a history of the repository's own."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tidegauge.functions.columns import Roles
from tidegauge.operators import cell_trees
from tidegauge.operators import models as M
from tidegauge.operators import temporal as T
from tidegauge.operators.bundle import evaluate

ROLES = Roles(key="lot", target="stay", period="month", class_code="grade", categorical=("yard", "cargo", "grade"))
FAMILIES = (T.family("yard"), T.family("cargo"), T.family("yard", "cargo"))
MONTHS, LAST = range(3, 11), 10
#: Lots of a yard and month, typical stay, and whether the yard is too small to stand alone.
YARDS = {"north": (60, 9.0), "quay": (45, 22.0), "inland": (40, 15.0), "remote": (3, 90.0)}


def lots():
    draw = random.Random(11)
    for month in MONTHS:
        for yard, (count, stay) in YARDS.items():
            for _ in range(count):
                cargo = draw.choice(["grain", "steel"])
                value = max(stay * (1.4 if cargo == "steel" else 1.0) + draw.gauss(0, 2) + 0.1 * month, 0.5)
                yield yard, cargo, draw.choice(["1", "2", "3"]), month, round(value, 2)


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(lots())], "lot int, yard string, cargo string, grade string, month int, stay double").cache()


@pytest.fixture(scope="module")
def split(history):
    return T.temporal_split(history, "stay", "month")


def test_the_last_month_is_held_out(split):
    per_month = sum(count for count, _ in YARDS.values())
    assert split.holdout == LAST
    assert split.train.count() == per_month * (len(MONTHS) - 1) and split.test.count() == per_month
    assert {(r["period"], r["n"]) for r in T.split_summary(split).filter("is_test").collect()} == {(LAST, per_month)}


def test_what_can_not_be_split_is_reported(history):
    for frame, code in ((history.drop("month"), "missing_week"), (history.drop("stay"), "missing_target"),
                        (history.filter(f"month = {LAST}"), "insufficient_temporal_history"), (history.limit(0), "temporal_ml_empty")):
        assert [r["code"] for r in T.split_problems(frame, "stay", "month").collect()] == [code]


def test_small_yards_share_a_segment_and_rows_fall_back(split):
    segments = T.build_segments(split, FAMILIES)
    flags = {r["label"]: r["representative"] for r in segments.sizes.filter("family = 'yard'").collect()}
    assert flags == {yard: count >= 30 for yard, (count, _) in YARDS.items()}
    table = T.heuristic_table(split, segments).collect()
    errors = [r["mae"] for r in table]
    assert errors == sorted(errors) and len(table) == len(FAMILIES) + 2
    layered = T.backoff_rows(split, segments)
    assert sum(r["n"] for r in T.tier_usage(layered).collect()) == split.test.count()
    scored = layered.withColumnRenamed("predicted", "heuristic").withColumn("regression", F.col("y")).drop("tier")
    report = T.segment_report(split, segments, scored).filter("family = 'yard'").collect()
    assert [r["segment"] for r in report] == ["north", "quay", "inland", "Other"]
    assert all(r["regression_mae"] == 0 < r["heuristic_mae"] for r in report)


def test_target_scales(split):
    steps = {r["step"]: r for r in T.target_diagnostics(split).collect()}
    assert set(steps) == {"raw", "log1p", "log1p_outlier_norm", "log1p_outlier_norm_restored"}
    assert steps["log1p_outlier_norm"]["outlier_ratio"] == 0 < steps["raw"]["outlier_ratio"]
    with pytest.raises(ValueError):
        T.transformed("square", T.target_bounds(split.train))


def test_metrics_match_numpy(split):
    rows = split.rows.withColumn("predicted", F.col("month") * 2.0)
    got = {r["is_test"]: r for r in T.regression_metrics(rows, ["is_test"], 5.0).collect()}
    for side in (False, True):
        y, p = np.array([(r["y"], r["predicted"]) for r in rows.filter(F.col("is_test") == side).collect()]).T
        want = (np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean()), np.median(np.abs(y - p)), np.abs(y - 5.0).mean())
        assert [got[side][k] for k in ("mae", "rmse", "medae", "baseline_mae")] == pytest.approx(want)


def test_benchmark_fits_every_learner_on_every_strategy(split):
    models = {**M.default_models(trees=10, rounds=25), "Spark tree": lambda: DecisionTreeRegressor(predictionCol="out"), "Booster of elsewhere": None}
    found = M.run_benchmark(split, models, ["raw", "log1p_outlier_norm"])
    rows = {(r["model_name"], r["strategy"]): r for r in found.rows.collect()}
    assert len(rows) == 1 + 4 * 2 + 1 and not rows[("Booster of elsewhere", "unavailable")]["available"]
    learned = [r for (_, strategy), r in rows.items() if strategy in ("raw", "log1p_outlier_norm")]
    assert all(r["n"] == split.test.count() and r["mae"] < r["baseline_mae"] for r in learned)
    # Cells lose nothing that a tree can see, so it is Spark ML's tree, but for splits of equal gain.
    assert rows[("Decision Tree", "raw")]["train_mae"] == pytest.approx(rows[("Spark tree", "raw")]["train_mae"], rel=1e-3)
    top = found.effects.filter("model_name = 'Gradient Boosting' and strategy = 'raw'").orderBy(F.desc("importance")).first()
    assert top["feature"] == "yard=remote"
    assert M.ranked_models(found.rows).collect()[-1]["model_name"] == "Booster of elsewhere"
    predictions = T.prediction_table(found.scored, "lot", "month", M.best_run(found)[2])
    assert predictions.count() == split.test.count() and predictions.filter("predicted < 0").count() == 0
    found.release()


def test_a_failing_fit_leaves_the_others_alone(split):
    class Broken:
        def fit(self, train):
            train.count()
            raise RuntimeError("no luck")
    found = M.run_benchmark(split, {"Broken": Broken, **M.default_models(trees=2, rounds=2)}, ["raw", "log1p"])
    assert {r["model_name"]: r["available"] for r in found.rows.collect()}["Broken"] is False
    assert len(found.runs) == 6 and found.warnings.filter("code = 'model_training_failed' and suggestion = 'no luck'").count() == 2


def test_too_many_cells_go_to_the_distributed_learner(spark, split, monkeypatch):
    rows = spark.range(400).selectExpr("cast(id % 90 AS double) AS num_0", "cast(id % 5 AS string) AS cat_0", "cast(id % 5 AS double) AS label")
    assert cell_trees.collapse(rows, ["label"], 10) is None
    chosen = cell_trees.CellTrees("boosting", 2, 1, 3, 0.5, 0.9, most_cells=10).distributed()
    assert isinstance(chosen, GBTRegressor) and (chosen.getMaxIter(), chosen.getStepSize(), chosen.getSubsamplingRate()) == (3, 0.5, 0.9)
    monkeypatch.setattr(M, "collapse", lambda train, targets: None)
    found = M.run_benchmark(split, M.default_models(trees=3, rounds=2), ["raw"])
    assert len(found.runs) == 3 and found.rows.filter("mae >= baseline_mae and strategy = 'raw'").count() == 0


def brute_split(x, y, w):
    """Best squared-error split of one number: gain and threshold."""
    def loss(part):
        mean = np.average(y[part], weights=w[part])
        return (w[part] * (y[part] - mean) ** 2).sum()
    whole = np.ones(len(x), bool)
    return max((loss(whole) - loss(x <= t) - loss(x > t), -t) for t in sorted(set(x))[:-1])


def test_trees_on_cells_match_brute_force():
    rng = np.random.default_rng(4)
    x, w = rng.integers(0, 9, 200), rng.integers(1, 5, 200).astype(float)
    y = np.where(x > 5, 3.0, 1.0) + rng.normal(0, 0.3, 200)
    tree, leaf = cell_trees.grown(x[None, :], [9], np.array([True]), w, w * y, 1)
    gain, minus = brute_split(x, y, w)
    assert tree.gain[0] == pytest.approx(gain) and tree.code[0] == -minus
    assert [np.average(y[leaf == k], weights=w[leaf == k]) for k in (0, 1)] == pytest.approx(tree.leaf.tolist())
    assert (tree.leaves(x[None, :], np.array([True])) == leaf).all()


def test_equal_seeds_give_equal_trees_whatever_the_partitions(spark, split):
    rows = split.train.selectExpr("cast(month AS double) AS num_0", "yard AS cat_0", "cargo AS cat_1", "y AS label")
    learner = cell_trees.CellTrees("boosting", 3, 5, 4, 0.1, 0.8)
    a, b = (learner.fit(rows.repartition(n)) for n in (1, 7))
    assert np.allclose([t.leaf for t in a.trees], [t.leaf for t in b.trees])
    unseen = spark.createDataFrame([(4.0, "nowhere", None)], "num_0 double, cat_0 string, cat_1 string")
    assert a.transform(unseen).first()["out"] > 0


def test_labels_are_hashed_on_demand(split):
    assert M.eligible_features(split).hashed == () and M.eligible_features(split, ["yard"]).hashed == ("yard",)


def test_combined_evaluation(history):
    few = {"Decision Tree": M.default_models()["Decision Tree"]}
    found = evaluate(history, ROLES, FAMILIES, few)
    assert found.comparison.first()["winner"] in {"regression", "heuristic", "tie"}
    assert {"temporal_holdout", "target_high_skew"} <= {r["code"] for r in found.warnings.collect()}
    assert found.regression.built and {r["feature"] for r in found.tests.collect()} >= {"yard", "cargo", "grade"}
    held = history.filter(f"month = {LAST}").count()
    assert sum(r["n"] for r in found.tiers.collect()) == found.predictions.count() == held
    assert found.segments.filter("regression_mae IS NULL").count() == 0
    alone = evaluate(history.filter(f"month = {LAST}"), ROLES, FAMILIES, few)
    assert alone.split is None and "insufficient_temporal_history" in {r["code"] for r in alone.warnings.collect()}
