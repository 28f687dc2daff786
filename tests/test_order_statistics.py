"""The distributed forms give what the one-task forms give, on skewed and tied data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import tails
from tidegauge.operators.profile import histogram, numeric_summary
from tidegauge.operators.variability import alphabetical_rank_sum
from tidegauge.plans import ordered, sizing
from tidegauge.plans.counts import ranked, value_counts


@pytest.fixture(scope="module")
def skewed(spark):
    """One key and one value hold a third of the rows each."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.when(F.col("id") % 3 == 1, 7.0).otherwise((F.col("id") * 7919 % 1013).cast("double")).alias("v"),
    )


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ordered_counts(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "MANY_SLICES", 20)
    one, many = (ordered.ordered_counts(skewed, ["k"], "v", small=s).select("k", "v", "n", "before", "total") for s in (True, False))
    assert same(one, many)
    assert same(*(ordered.ordered_counts(skewed, [], "v", small=s).select("v", "n", "before", "total") for s in (True, False)))


def test_quantiles(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "MANY_SLICES", 20)
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    one, many = (ordered.quantiles(skewed, ["k"], "v", probs, small=s).orderBy("k").collect() for s in (True, False))
    assert [r["k"] for r in one] == [r["k"] for r in many]
    for a, b in zip(one, many):
        assert [a[p] for p in probs] == pytest.approx([b[p] for p in probs])
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 2)
    beyond = ordered.quantiles(skewed, ["k"], "v", probs, small=False).orderBy("k").collect()
    assert [r["d"] for r in beyond] == pytest.approx([r["d"] for r in one])
    monkeypatch.undo()
    nulls = skewed.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    grouped = {r["k"]: r["c"] for r in ordered.quantiles(nulls, ["k"], "v", probs, small=False).collect()}
    assert grouped == pytest.approx({r["k"]: r["c"] for r in nulls.groupBy("k").agg(F.percentile("v", 0.5).alias("c")).collect()})
    weighted = skewed.groupBy("k", "v").agg(F.count("*").alias("w"))
    again = ordered.quantiles(weighted, ["k"], "v", probs, weight="w", small=False).orderBy("k").collect()
    assert [r["c"] for r in again] == pytest.approx([r["c"] for r in one])


def test_attach_large(skewed, monkeypatch):
    lookup = skewed.groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("top"), F.lit(None).cast("string").alias("blank"))
    plain = skewed.join(lookup.drop("w"), "k", "left").select("k", "v", "top", "blank")
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(sizing, "HOT_KEYS", 3)
    assert same(plain, sizing.attach(skewed, lookup, ["k"], "w").select("k", "v", "top", "blank"))
    assert same(plain, sizing.attach(skewed, lookup.drop("w"), ["k"]).select("k", "v", "top", "blank"))
    missing = sizing.attach(skewed, lookup.filter("k <> 'hot' AND k <> 'k1'"), ["k"], "w")
    assert missing.filter("top IS NULL").count() == skewed.filter("k IN ('hot', 'k1')").count()


def test_ranked_large_k(skewed):
    counts = value_counts(skewed, ["k", "v"])
    order = [F.desc("n"), F.asc("value")]
    few = ranked(counts, ["column"], order, 7)
    many = ranked(counts, ["column"], order, 5000)
    assert same(few, many.filter("rank <= 7")) and many.count() == counts.count()


def test_alphabetical_positions(skewed):
    counts = value_counts(skewed, ["k"])
    assert same(alphabetical_rank_sum(counts, small=True), alphabetical_rank_sum(counts, small=False))


def test_summary_and_histogram_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.exponential(5, 400), [np.nan, 90.0, 90.0]])
    df = spark.createDataFrame([(float(v), 4.0) for v in data], "v double, flat double")
    clean = data[~np.isnan(data)]
    for small in (True, False):
        row = numeric_summary(df, ["v"], small).first()
        assert row["n"] == len(clean)
        assert [row["mean"], row["std"], row["p25"], row["p75"]] == pytest.approx(
            [clean.mean(), clean.std(ddof=1), np.quantile(clean, 0.25), np.quantile(clean, 0.75)])
        z = (clean - clean.mean()) / clean.std()
        n = len(clean)
        assert row["skewness"] == pytest.approx((z**3).mean() * np.sqrt(n * (n - 1)) / (n - 2))
    bins = histogram(df, ["v"]).orderBy("bin").collect()
    edges = [b["left"] for b in bins] + [bins[-1]["right"]]
    assert [b["count"] for b in bins] == np.histogram(clean, bins=edges)[0].tolist()
    flat = histogram(df, ["flat"]).collect()
    assert len(flat) == 1 and (flat[0]["left"], flat[0]["right"], flat[0]["count"]) == (3.5, 4.5, len(data))


def test_tails_against_closed_forms():
    assert tails.chi2_tail(3.0, 2) == pytest.approx(np.exp(-1.5))
    assert tails.chi2_tail(400.0, 2) == pytest.approx(np.exp(-200.0))
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert tails.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / np.sqrt(6))
    assert tails.f_tail(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5)
    assert tails.t_quantile(0.025, 1e7) == pytest.approx(1.959964, abs=1e-5)
    for dof, want in ((1e6, 0.0499960676), (1e9, 0.0499957903), (1e12, 0.0499957902)):
        assert tails.t_two_sided(1.96, dof) == pytest.approx(want, rel=1e-7)
    assert tails.f_tail(1.96**2, 1, 1e12) == pytest.approx(0.0499957902, rel=1e-7)
    assert tails.chi2_tail(1e8, 1e8) == pytest.approx(0.5, abs=1e-4)
    assert tails.f_tail(None, 1, 1) is None and tails.chi2_tail(float("nan"), 2) is None
