"""Bins of the automatic histogram, counted by a search among their edges."""

from __future__ import annotations

from collections import Counter

import pytest

from tidegauge.operators import profile as P


def test_each_value_counts_in_the_bin_whose_edges_hold_it(spark):
    rows = [(float(i * i % 97), 7.0, None, None if i % 3 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "wide double, flat double, empty double, gaps int")
    found = P.histogram(df).collect()
    edges = {c: sorted((r["left"], r["right"], r["bin"], r["count"]) for r in found if r["column"] == c) for c in {r["column"] for r in found}}
    assert set(edges) == {"wide", "flat", "gaps"} and len(edges["flat"]) == 1
    for column, place in (("wide", 0), ("flat", 1), ("gaps", 3)):
        values, bins = [r[place] for r in rows if r[place] is not None], edges[column]
        want = Counter(next(b for left, right, b, _ in bins if left <= v < right or (v == right and b == bins[-1][2])) for v in values)
        assert {b: n for _, _, b, n in bins} == {b: want.get(b, 0) for _, _, b, _ in bins}


def test_counts_come_from_edges_alone(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (4.0,), (None,)], "x double")
    edges = spark.createDataFrame([("x", 0, 1.0, 2.0), ("x", 1, 2.0, 2.0), ("x", 2, 2.0, 4.0)], "column string, bin int, left double, right double")
    assert {r["bin"]: r["count"] for r in P._bin_counts(df, ["x"], edges).filter("bin IS NOT NULL").collect()} == {0: 1, 2: 3}
    assert P._bin_counts(df, ["x"], edges.limit(0)).count() == 0


def test_a_table_without_numbers_has_no_bins(spark):
    assert P.histogram(spark.createDataFrame([(None,)], "x double")).count() == 0
    with pytest.raises(StopIteration):
        next(iter(P.histogram(spark.createDataFrame([("a",)], "x string")).collect()))
