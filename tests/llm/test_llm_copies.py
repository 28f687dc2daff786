"""Exact and near copies, components and their removal."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from frames import awkward, awkward_rows, empty, rows
from tidegauge.llm import simhash
from tidegauge.llm.common import components
from tidegauge.llm.exact_dedup import exact_dedup, exact_groups
from tidegauge.llm.simhash import GrayTree, fingerprint, gray_rank, near_dedup, near_links, simhash_components


def brute_exact(data):
    groups = defaultdict(list)
    for doc_id, text in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for n, i in enumerate(ids):
            out.append((i, keep, len(ids), i == keep and i not in ids[:n], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_match_brute_force_even_when_hashes_collide(spark, weak):
    hash_of = {"content_hash": lambda sha: F.substring(F.hex(sha), 1, 0)} if weak else {}
    got = rows(exact_groups(awkward(spark), **hash_of).drop("__row"))
    assert got == brute_exact([r[:2] for r in awkward_rows()])


def test_exact_groups_of_an_empty_table(spark):
    assert rows(exact_groups(empty(spark))) == []


def test_exact_dedup_keeps_one_row_of_a_group_with_all_columns(spark):
    docs = awkward(spark).withColumn("own_digest", F.lit("z"))
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0]) for r in kept.collect()) == sorted(
        (i is None, i) for i in [1, 3, 4, 6, 7, 8, 9, 10, 11, -12] if i != 3)
    assert exact_dedup(empty(spark)).count() == 0


def test_one_group_of_half_the_rows_is_joined_whole(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_groups(docs)
    assert found.where("group_size = 2000 and keep_id = 0").count() == 2000
    assert found.where("kept").count() == 2001


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_matches_the_definition(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    for row in awkward_rows():
        assert fingerprint(row[1] or "") % 2**64 == brute_fingerprint(row[1])


def test_components_of_awkward_documents(spark):
    data = [(r[0], brute_fingerprint(r[1])) for r in awkward_rows()]
    roots = brute_components([p for _, p in data])
    lowest = {}
    for (doc_id, _), root in zip(data, roots):
        lowest[root] = min(x for x in (lowest.get(root), doc_id) if x is not None) if (lowest.get(root), doc_id) != (None, None) else None
    want = sorted(((i, f"{p:016x}", lowest[root]) for (i, p), root in zip(data, roots)), key=str)
    assert rows(simhash_components(awkward(spark))) == want
    assert rows(simhash_components(empty(spark))) == []


def clustered_prints(n, seed):
    random.seed(seed)
    centres = [random.getrandbits(64) for _ in range(n // 20)]
    return list({random.choice(centres) ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 7))) for _ in range(n)})


@pytest.mark.parametrize("tile", [40, 100_000])
def test_links_connect_what_all_pairs_connect(spark, tile):
    prints = clustered_prints(1500, 3) + [0, 15, 2**64 - 1]
    prints += [(0xABC << 40) | (random.getrandbits(18)) for _ in range(400)]
    prints = list(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), tile)
    got = dict(components(links).collect())
    want = brute_components(prints)
    classes, found = defaultdict(set), defaultdict(set)
    for p, root in zip(signed, want):
        classes[root].add(p)
        found[got.get(p, p)].add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))


def test_tree_prunes_and_bounds_its_frontier(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 256)
    prints = np.array(sorted(clustered_prints(600, 5)), np.uint64)
    groups = np.repeat([0, 1], [400, len(prints) - 400])
    root = GrayTree(prints, groups).link()
    for part in (0, 1):
        own = np.flatnonzero(groups == part)
        want = brute_components([int(p) for p in prints[own]])
        assert [int(r - own[0]) for r in root[own]] == want


def test_gray_rank_undoes_the_gray_code(spark):
    codes = spark.createDataFrame([(n, n ^ (n >> 1)) for n in (0, 1, 2, 3, 77, 2**40 + 5)], "n bigint, code bigint")
    assert all(r.n == r.g + 2**63 for r in codes.select("n", gray_rank(F.col("code")).alias("g")).collect())


def test_near_dedup_keeps_the_smallest_id_of_each_component(spark):
    docs = awkward(spark).withColumn("own_key", F.lit(5))
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    groups = {}
    for doc_id, _, component in rows(simhash_components(awkward(spark))):
        groups.setdefault(component, set()).add(doc_id)
    got = [r[0] for r in kept.collect()]
    assert sorted(got, key=str) == sorted(groups, key=str)
    assert near_dedup(empty(spark)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 60)]
    got = dict(components(spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {i: 0 for i in range(60)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
