"""Every registered statement belongs to a query, and sampled queries match their SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import connect, difference

SMALL = "/root/testdata/sf0.001"
SAMPLED = [
    "pivot_median_orders", "histogram_lineitem", "outlier_columns_lineitem", "merge_report", "chi2_pairs_documents",
    "group_tests_flow", "heuristic_metrics_flow", "backoff_tier_usage", "mutual_information_flow", "segment_sizes_flow",
]


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLED)
def test_query_matches_sql(spark, name):
    assert difference(contract.queries()[name](spark, SMALL), connect(SMALL), contract.oracle_sql()[name]) is None
