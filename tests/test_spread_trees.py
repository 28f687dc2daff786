"""Trees on cells that stay spread over tasks, against trees of one task."""

from __future__ import annotations

import numpy as np
import pytest

from tidegauge.operators import cell_trees, spread_trees
from tidegauge.operators import models as M
from tidegauge.operators import temporal as T


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(8000).selectExpr(
        "cast(id % 90 AS double) AS num_0", "cast(id % 5 AS string) AS cat_0", "cast(id % 700 AS string) AS cat_1",
        "cast(id % 5 + id % 7 * cast(id % 700 = 3 AS int) + 9 * cast(id % 700 = 11 AS int) AS double) AS label").cache()


@pytest.mark.parametrize("kind", ["tree", "boosting"])
def test_spread_cells_give_the_trees_of_one_task(rows, kind):
    learner = cell_trees.CellTrees(kind, 4, 5, 3, 0.3, 1.0)
    cells = spread_trees.spread_cells(rows, ["label"])
    one, many = learner.fit(rows), spread_trees.fit_spread(cells, learner, ["label"])[0]
    assert cells.wide == 2 and any(2 in t.feature for t in many.trees)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and np.allclose(a.gain, b.gain) and np.allclose(a.leaf, b.leaf)
    both = many.transform(rows.withColumn("one", one.predicted())).selectExpr("max(abs(one - out)) AS gap").first()
    assert both["gap"] < 1e-9
    names = lambda model: {(column, level): round(share, 6) for column, level, share in model.effects()}
    assert names(one) == names(many)
    cells.release()


def test_draws_do_not_depend_on_the_number_of_tasks(rows, monkeypatch):
    learner, found = cell_trees.CellTrees("forest", 3, 5, 4), []
    for buckets in (1, 3):
        monkeypatch.setattr(type(rows.sparkSession.sparkContext), "defaultParallelism", buckets)
        cells = spread_trees.spread_cells(rows, ["label"])
        assert cells.shares.getNumPartitions() == buckets
        found.append(spread_trees.fit_spread(cells, learner, ["label"])[0])
        cells.release()
    assert all(np.allclose(a.leaf, b.leaf) and a.feature.tolist() == b.feature.tolist() for a, b in zip(found[0].trees, found[1].trees, strict=True))


def test_two_wide_labels_are_left_to_the_distributed_learner(rows):
    assert spread_trees.spread_cells(rows.selectExpr("*", "concat(cat_1, cat_0) AS cat_2"), ["label"]) is None


def test_a_grid_with_a_wide_label_needs_no_vector(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("cast(id % 600 AS string) AS owner", "cast(id % 4 AS string) AS kind", "cast(id % 5 + 1 AS int) AS month",
                                        "cast(10 + 5 * (id % 4) + 40 * cast(id % 600 = 7 AS int) AS double) AS stay")
    monkeypatch.setattr(M, "collapse", lambda train, targets: None)
    monkeypatch.setattr(M, "preprocessing", lambda features: pytest.fail("one slot per level was built"))
    found = M.run_benchmark(T.temporal_split(rows, "stay", "month"), M.default_models(trees=3, rounds=3), ["raw", "log1p"])
    assert len(found.runs) == 6 and found.rows.filter("strategy <> 'baseline' and mae >= baseline_mae").count() == 0
    assert found.effects.filter("feature = 'owner=7'").count() > 0
    found.release()
