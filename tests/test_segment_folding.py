"""Segments: small labels are folded before their values are counted, and only those that stay apart are looked up."""

from __future__ import annotations

from statistics import median

import pytest

from tidegauge.functions.columns import OTHER_LABEL
from tidegauge.operators import temporal as T


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(400):
        owner = "big" if i % 2 else f"o{i % 80:02d}"
        out.append((owner, "uv"[i % 3 == 0], 1 + i % 4, float(i % 37)))
    return out


def test_only_representative_labels_are_looked_up(spark, rows, monkeypatch):
    split = T.temporal_split(spark.createDataFrame(rows, "Owner string, Type string, week int, value double"), "value", "week")
    looked_up, real = [], T.attach
    monkeypatch.setattr(T, "attach", lambda big, lookup, on, weight=None: (looked_up.append(lookup.count()), real(big, lookup, on, weight))[1])
    monkeypatch.setattr(T, "baseline_median", lambda split: pytest.fail("the cells hold all rows"))
    families = (T.family("Owner"), T.family("Owner", "Type"))
    found = T.build_segments(split, families, train_rows=20, holdout_rows=10)
    apart = found.sizes.filter("representative").count()
    assert found.sizes.count() > 40 and looked_up == [apart]
    predicted = T.family_rows(split, found, families[0])
    assert looked_up[1] == found.sizes.filter("representative AND family = 'owner'").count() == 1
    train = [r for r in rows if r[2] < 4]
    want = {own: median(r[3] for r in train if (r[0] == "big") == own) for own in (True, False)}
    assert {(r["Owner"] == "big", r["predicted"]) for r in predicted.collect()} == set(want.items())
    assert found.baseline == median(r[3] for r in train)
    medians = {r["segment"]: r["median"] for r in found.medians.filter("family = 'owner'").collect()}
    assert medians == {"big": want[True], OTHER_LABEL: want[False]}
    assert found.cells.selectExpr("sum(w)").first()[0] == 2 * len(rows)
