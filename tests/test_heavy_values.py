"""Most frequent values through the sketch against plain counting."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.profile import top_categories
from tidegauge.plans.counts import top_values, value_counts
from tidegauge.plans.heavy import _merged, candidates, top_counts


def test_summary_bounds_hold():
    picked, true, cuts = random.Random(3), Counter(), 0
    values, counts = pa.array([], pa.string()), np.empty(0, np.int64)
    for _ in range(40):
        batch = Counter(f"v{min(int(picked.paretovariate(0.6)), 900)}" for _ in range(500))
        true.update(batch)
        values, counts, cut = _merged(
            pa.concat_arrays([values, pa.array(list(batch), pa.string())]), np.concatenate([counts, np.array(list(batch.values()))]), 20)
        cuts += cut
    kept = dict(zip(values.to_pylist(), counts))
    assert len(kept) <= 20 and 0 < cuts <= 40 * 500 / 21
    assert all(kept.get(v, 0) <= n <= kept.get(v, 0) + cuts for v, n in true.items())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one value, a long tail, a unique column, a flat one, blanks and an empty column."""
    i = F.col("id")
    return spark.range(30_000).repartition(6).select(
        F.when(i % 3 == 0, "hot").when(i % 7 < 3, F.concat(F.lit("warm"), i % 7)).otherwise(F.concat(F.lit("cold"), i)).alias("skewed one"),
        i.cast("string").alias("unique"), (i % 3000).cast("string").alias("flat"),
        F.when(i % 5 > 0, F.when(i % 2 == 0, "even").otherwise("")).alias("blank"), F.lit(None).cast("string").alias("none"))


def test_same_rows_as_counting_everything(spark, skewed):
    names = skewed.columns
    want = {tuple(r) for r in top_values(value_counts(skewed, names), 4).select("column", "value", "n", "rank").collect()}
    for counters in (4, 64, 5_000, 100_000):
        got = top_counts(skewed, names, 4, counters).collect()
        assert {(r["column"], r["value"], r["n"], r["rank"]) for r in got} == want and {r["n_rows"] for r in got} == {30_000}, counters


def test_settled_columns_count_few_candidates(spark, skewed):
    found, rows, left_open = candidates(skewed, skewed.columns, 4, 64)
    assert left_open == ["unique", "flat"] and set(rows.values()) == {30_000}
    held = [tuple(r) for r in found.collect()]
    assert {v for n, v in held if n == "skewed one"} >= {"hot", "warm0", "warm1", "warm2"} and len(held) < 400


def test_empty_table_and_categories(spark, skewed):
    assert top_counts(skewed.limit(0), skewed.columns).collect() == []
    frame = skewed.select("skewed one", "flat")
    plain, sketched = (top_categories(frame, 5, sketched=s).collect() for s in (False, True))
    assert sorted(map(str, plain)) == sorted(map(str, sketched))
