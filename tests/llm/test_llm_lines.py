"""Line dedup against brute force, and the perfect hash on its own."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import awkward, awkward_rows, empty, rows
from tidegauge.llm import line_dedup as module
from tidegauge.llm.line_dedup import STRIPPED, Shard, build_shards, line_dedup, probed
from tidegauge.llm.perfect_hash import PerfectHash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in data]

    def key(line):
        return line.strip(STRIPPED).translate(LOWER)

    for doc_id, lines in split:
        for line in lines:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    often = {k: v for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc_id, lines in split:
        def gone(line):
            known = [i for i in often.get(key(line), ()) if i is not None]
            return key(line) in often and doc_id != (max(known) if known else None)
        kept = "\n".join(x for x in lines if not gone(x))
        most = max((len(often.get(key(x), ())) for x in lines), default=0)
        out.append((doc_id, len(lines), sum(map(gone, lines)), most, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_lines_data():
    rng = random.Random(5)
    pool = [f"line {k} " + "".join(rng.choice("abcdé ") for _ in range(rng.randint(25, 60))) for k in range(60)]
    data = []
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"only {i} {k} " + "x" * 50 for k in range(rng.randint(1, 12))]
        lines = [f" \t{x.upper()}\x0b" if rng.random() < 0.3 else x for x in lines] + ["the most common line of all, in every document that there is"]
        data.append((i % 140, "\n".join(lines)))
    return [*data, (None, data[0][1]), (None, "the most common line of all, in every document that there is"), (900, None), (901, ""), (902, "\n\n")]


@pytest.mark.parametrize("shared", [1_500_000, 3, 0])
def test_lines_match_brute_force_wherever_the_arrays_lie(spark, shared):
    data = shared_lines_data()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({n: F.lit("z") for n in ("id", "a", "shard", "found", "of")})
    assert rows(line_dedup(docs.repartition(4), shared_lines=shared)) == brute(data)


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_documents(spark, make):
    want = brute([r[:2] for r in awkward_rows()]) if make is awkward else []
    assert rows(line_dedup(make(spark))) == want
    low = line_dedup(make(spark), min_chars=1, min_docs=2)
    assert rows(low) == (brute([r[:2] for r in awkward_rows()], 1, 2) if make is awkward else [])


def test_text_without_the_dropped_lines(spark):
    line = "a line of more than forty code points that repeats"
    docs = spark.createDataFrame([(i, f"own {i}\n  {line.upper()} \nend\n{line}") for i in range(5)], "doc_id int, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup(docs, with_text=True).collect()}
    assert got == {**{i: f"own {i}\nend" for i in range(4)}, 4: f"own 4\n  {line.upper()} \nend\n{line}"}


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_numbers_each_key_once(size):
    keys = np.unique(np.random.default_rng(size).integers(0, 1 << 64, size, np.uint64))
    found = PerfectHash.unpacked(PerfectHash.build(keys).packed())
    assert sorted(found.numbers(keys).tolist()) == list(range(len(keys)))
    others = found.numbers(~keys)
    assert ((others >= -1) & (others < max(len(keys), 1))).all()
    assert size < 1000 or len(found.packed()) * 8 / len(keys) < 8


def test_equal_keys_are_no_perfect_hash():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([3, 3], np.uint64))


def test_lines_with_the_same_first_half_are_told_apart(spark, monkeypatch):
    lines = spark.createDataFrame([(7, 1, 5, 10), (7, 2, 6, 20), (7, 3, 7, 30), (8, 1, 9, 40)], "a bigint, b bigint, docs bigint, keeper bigint")
    shards = {r["shard"]: Shard.unpacked(r) for r in build_shards(lines, 2).collect()}
    a, b = np.array([7, 7, 7, 7, 8, 9]), np.array([1, 2, 3, 4, 1, 1])
    docs, keepers = probed(shards, 2, a, b)
    assert docs.tolist() == [5, 6, 7, 0, 9, 0] and keepers[[0, 1, 2, 4]].tolist() == [10, 20, 30, 40]
    # The same through the operator: a hash whose first half is always the same.
    data = [(i, f"{'p' * 45}\n{'q' * 45}\n{'r' * 45}") for i in range(6)]

    def weak(text):
        return b"samehalf" + hashlib.md5(text).digest()[:8]
    monkeypatch.setattr(module.xxhash, "xxh3_128_digest", weak)
    found, keys = module.long_lines(data[0][1].split("\n"), 40)
    assert found == [0, 1, 2] and len(set(keys[:, 0].tolist())) == 1


def test_shards_are_built_by_many_tasks(spark):
    lines = spark.range(40_000).selectExpr("xxhash64(id) AS a", "id AS b", "id AS docs", "id AS keeper")
    built = build_shards(lines, 8)
    assert built.count() == 8 and built.agg(F.sum("size")).first()[0] == 40_000
    assert built.select(F.spark_partition_id()).distinct().count() > 2
