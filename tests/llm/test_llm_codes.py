"""Vector codes and the tree of entries against brute force; fill-in-middle against plain strings."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import awkward, awkward_rows, empty, rows
from tidegauge.llm.fill_middle import Frames, cuts, fill_in_middle, restored, transformed
from tidegauge.llm.vector_codes import Gnat, nearest_entries, vector_codes


def nearest(x, book):
    best = min((sum((a - b) ** 2 for a, b in zip(x, entry)), k) for k, entry in enumerate(book))
    return best[1], best[0]


def brute_codes(data, rounds=4, entries=256):
    kept = [(i, [math.floor(1024 * v) for v in x], label) for i, x, label in data
            if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], float).tobytes()))
    size = len(kept[0][1])
    alike = [r for r in kept if len(r[1]) == size and size and size % 4 == 0]
    step = size // 4

    def part(x, p):
        return x[p * step : (p + 1) * step]

    books = [[part(x, p) for _, x, _ in alike[:entries]] for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            groups = [[] for _ in books[p]]
            for _, x, _ in alike:
                groups[nearest(part(x, p), books[p])[0]].append(part(x, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else entry for g, entry in zip(groups, books[p])]
    out = []
    for i, x, label in kept:
        found = [nearest(part(x, p), books[p]) for p in range(4)] if len(x) == size and alike else None
        out.append([i, "".join(f"{k:02x}" for k, _ in found) if found else None, sum(d for _, d in found) if found else None, label])
    totals = {}
    for _, _, error, label in out:
        if error is not None:
            totals[label] = totals.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted(((i, c, e, totals.get(label), sha) for i, c, e, label in out), key=str)


SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, row int, packed string, `of` int"


def vectors(spark, data):
    return spark.createDataFrame([(*r, "x", 1, "p", 2) for r in data], SCHEMA).repartition(3)


def float32(x):
    return None if x is None else [None if v is None else float(np.float32(v)) for v in x]


def some_vectors(count, seed=3, size=8, spread=0.02):
    rng = random.Random(seed)
    return [(i, float32([rng.gauss(0, spread) for _ in range(size)]), rng.choice([0, 1, 2, None])) for i in range(count)]


def test_codes_match_brute_force(spark):
    odd = [(-5, None, 1), (-4, [0.1, None, *[0.0] * 6], 1), (-3, [float("nan")] * 8, 1), (-2, [float("inf")] * 8, 1), (None, [0.25] * 8, None),
           (7, float32([0.01] * 8), 3), (7, float32([0.01] * 8), 3), (500, float32([0.5, 0.5]), 3), (501, [], 1), (502, float32([1e9] * 8), 2)]
    data = some_vectors(400) + odd
    got = rows(vector_codes(vectors(spark, data)))
    assert got == brute_codes(data)


def test_few_equal_and_no_vectors(spark):
    assert rows(vector_codes(vectors(spark, []))) == []
    same = [(i, float32([0.5, -0.25] * 4), None) for i in range(5)]
    assert rows(vector_codes(vectors(spark, same))) == brute_codes(same)
    uneven = [(1, [0.5] * 6, 1), (2, [0.5] * 6, 1)]
    assert [r[:4] for r in rows(vector_codes(vectors(spark, uneven)))] == [(1, None, None, None), (2, None, None, None)]


@pytest.mark.parametrize("spread,size", [(3, 2), (40, 4), (100_000, 16), (10**12, 3)])
def test_tree_finds_the_nearest_entry_and_the_lower_index_of_ties(spread, size):
    rng = np.random.default_rng(size)
    book = rng.integers(-spread, spread + 1, (256, size)).astype(object)
    book[200:] = book[:56]
    queries = rng.integers(-spread, spread + 1, (300, size)).astype(float)
    entry, error = nearest_entries(queries, book)
    want = [nearest([int(v) for v in q], book.tolist()) for q in queries]
    assert [(int(e), int(d)) for e, d in zip(entry, error)] == want


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    book = np.concatenate([rng.integers(-40, 40, (32, 4)) + 5000 * k for k in range(8)]).astype(float)
    tree, seen = Gnat(book, np.arange(256)), []
    search = Gnat.search

    def counted(self, queries, at, best, entry):
        seen.append(len(at) * len(self.points))
        return search(self, queries, at, best, entry)
    Gnat.search = counted
    try:
        entry, _ = nearest_entries(book[::5], book, tree)
    finally:
        Gnat.search = search
    assert entry.tolist() == list(range(0, 256, 5))
    assert sum(seen[1:]) < 0.3 * 52 * 256


def brute_fill(doc_id, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    cut = (None, None) if form == "plain" else (a, b - a)
    return (doc_id, n, form, *cut, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), out)


@pytest.mark.parametrize("units", [7, 1 << 16])
def test_forms_match_brute_force(spark, units):
    data = [*[r[:2] for r in awkward_rows()], *[(100 + i, f"é{'ab😀<' * (i % 40)} <P" + ("<S>" if i % 11 == 0 else "")) for i in range(120)]]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in data], "doc_id bigint, text string, id string, n int, special boolean").repartition(3)
    got = rows(fill_in_middle(docs, units=units, with_output=True))
    assert got == sorted((brute_fill(*r) for r in data), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert rows(fill_in_middle(awkward(spark), units=units)) == sorted((brute_fill(*r[:2])[:-1] for r in awkward_rows()), key=str)
    assert rows(fill_in_middle(empty(spark))) == []


def test_frames_read_only_what_holds_the_span():
    text = "".join(chr(97 + i % 26) + "é" for i in range(500))
    frames = Frames.of([text[:333], "", text[333:]], 64)
    assert frames.units == 1000 and len(frames.frames) == 16 and "".join(frames.read(0, 1000)) == text
    opened, plain = [], Frames._unpacker

    class Counting:
        def decompress(self, data):
            opened.append(data)
            return plain.decompress(data)
    frames._unpacker = Counting()
    assert "".join(frames.read(130, 250)) == text[130:250] and len(opened) == 2
    assert frames.find(text[60:70], 0) == text.find(text[60:70]) and frames.find("zz", 0) == -1


def test_restoring_needs_only_output_and_form():
    for form in ("psm", "spm"):
        text = Frames.of(["one two <three>"], 4)
        out = Frames.of(transformed(text, form, 4, 9), 3)
        assert "".join(restored(out, form)) == "one two <three>"
    with pytest.raises(ValueError):
        restored(Frames.of(["no marks"]), "psm")
    assert cuts(3, 0, False)[0] == "plain"


def test_frames_stay_on_shared_storage(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 300) for i in range(20)], "doc_id int, text string")
    fill_in_middle(docs, f"file://{tmp_path}/frames", units=500).count()
    stored = spark.read.parquet(f"{tmp_path}/frames")
    assert stored.count() == 20 and stored.select(F.max(F.size("frames"))).first()[0] == 3
