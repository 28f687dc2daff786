"""Registered operators against their SQL, and the pipeline against its stages."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from compare import connect, difference
from frames import awkward, empty

SMALL = "/root/testdata/sf0.001"
OPERATORS = [n for n in contract.queries() if n.startswith("op")]


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in OPERATORS) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in OPERATORS if n in contract.oracle_sql()])
def test_operator_matches_sql(spark, name):
    assert difference(contract.queries()[name](spark, SMALL), connect(SMALL), contract.oracle_sql()[name]) is None


def test_pipeline_keeps_one_of_each_copy_and_packs_the_rest(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    language, exact, near, mixed, packed = kept
    assert language.count() == 200
    assert exact.count() == docs_distinct(language) and near.count() < exact.count()
    assert mixed.select("doc_id").distinct().count() <= near.count()
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in mixed.select("doc_id").distinct().collect()}
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed.collect()))


def docs_distinct(docs):
    return docs.selectExpr(r"regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ') AS t").distinct().count()


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_bear_awkward_documents(spark, make, tmp_path):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.columns[0] == "doc_id"
