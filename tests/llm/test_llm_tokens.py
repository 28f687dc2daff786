"""Token counts, packing, the encoder's memory, and language-model scores."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frames import awkward, awkward_rows, empty, rows
from tidegauge.llm import language_model, packing
from tidegauge.llm.encoding import SPACE_AND_WORD, WORD_ONLY, PieceEncoder
from tidegauge.llm.language_model import LogBloom, count_of_level, language_model_scores, levels_of, mixed
from tidegauge.llm.packing import hilbert_keys, pack
from tidegauge.llm.token_counts import count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = [chr(c) for c in (9, 10, 11, 13, 32, 32, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x1C, 0x1F, 0x200B, 0x301, 0x41, 0x61, 0x3A3, 0x130,
                          0xDF, 0x27, 0x73, 0x31, 0x2E, 0x1F600, 0x4E00, 0xFEFF, 0xE9)] + ["<|endoftext|>", "'re", "the", " the"]


@pytest.mark.parametrize("path,pieces", [(BYTES, SPACE_AND_WORD), (WORDS, WORD_ONLY)])
def test_pieces_give_the_ids_of_whole_texts(path, pieces):
    random.seed(7)
    encoder = PieceEncoder(path, pieces, memory=20)
    for _ in range(4000):
        text = "".join(random.choice(SIGNS) for _ in range(random.randint(0, 14)))
        got = np.frombuffer(encoder.encoded(text), encoder.dtype).tolist()
        assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
    assert len(encoder.young) <= 40 and not any(len(p) > 256 for p in encoder.young)


def test_counts_match_the_library_and_stay_in_the_cache(spark, tmp_path):
    cache, tokenizer = f"file://{tmp_path}/cache", Tokenizer.from_file(WORDS)
    want = []
    for row in awkward_rows():
        text = row[1] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        want.append((row[0], len(text.encode()), n, n > 2048))
    assert rows(count_tokens(awkward(spark), WORDS, cache)) == sorted(want, key=str)
    contents = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in awkward_rows()}
    assert spark.read.parquet(cache).count() == len(contents)
    assert rows(count_tokens(awkward(spark), WORDS, cache)) == sorted(want, key=str)
    assert spark.read.parquet(cache).count() == len(contents)
    assert rows(count_tokens(empty(spark), WORDS, cache)) == []


def whole_ids(text):
    return np.array([*Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("slice_tokens", [1000, 10**9])
def test_packing_is_an_exact_round_trip(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(packing, "SLICE_TOKENS", slice_tokens)
    found = pack(awkward(spark), BYTES, with_ids=True).toPandas()
    assert (found.ids.map(zlib.crc32) == found.ids_crc32).all() and (found.ids.map(len) == 4 * found.length).all()
    pieces = defaultdict(list)
    for row in found.itertuples():
        pieces[None if row.doc_id != row.doc_id else int(row.doc_id)].append((row.start, row.ids, row.doc_tokens))
    want = defaultdict(list)
    for row in awkward_rows():
        want[row[0]].append(whole_ids(row[1]).tobytes())
    for doc_id, texts in want.items():
        got = sorted(pieces[doc_id])
        assert sum(len(ids) for _, ids, _ in got) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(ids for _, ids, _ in got) == texts[0] and got[0][2] * 4 == len(texts[0])
    found = found.sort_values(["sequence_id", "offset"])
    sums = found.groupby("sequence_id").length
    assert (found.offset == sums.cumsum() - found.length).all()
    assert (sums.sum().iloc[:-1] == 1024).all() and list(sums.sum().index) == list(range(len(sums.sum())))


def test_packing_an_empty_table(spark):
    assert rows(pack(empty(spark), BYTES)) == []


def test_hilbert_keys_visit_every_cell_by_unit_steps():
    for dimensions, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_equal_documents_fill_many_slices(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'same words in every one of them' AS text")
    found = pack(docs, BYTES)
    assert found.rdd.getNumPartitions() > 3
    sizes = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert max(sizes) < 3 * sum(sizes) / len(sizes)


def brute_base(data):
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in data]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in data]
    counts = Counter(w for words, h in zip(tokens, held) if not h for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
            for (i, _), h, words in zip(data, held, tokens)]


@pytest.mark.parametrize("known", [0, 5, 1 << 21])
def test_base_scores_are_exact_however_few_words_are_broadcast(spark, known):
    got = rows(language_model_scores(awkward(spark), filter_bits=1 << 20, known_words=known))
    want = sorted(brute_base([r[:2] for r in awkward_rows()]), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r[6] < 0 for r in got)


def brute_score(data):
    value = count_of_level()
    tokens = [[b"\n", *(t or "").encode().lower().split(), b"\n"] for _, t in data]
    train = [words for (i, _), words in zip(data, tokens) if zlib.crc32(str(i).encode()) % 10]
    single, double = Counter(w for words in train for w in words[1:]), Counter(p for words in train for p in zip(words, words[1:]))
    about = lambda c: float(value[levels_of(np.array([c]))[0]]) if c else 0.0
    below = sum(single.values()) + 0.1 * (len(single) + 1)
    out = []
    for (i, _), words in zip(data, tokens):
        terms = [(about(single[a]), (about(single[b]) + 0.1) / below, about(double[a, b])) for a, b in zip(words, words[1:])]
        out.append((i, sum(math.log10((min(both, before) + 20 * alone) / (before + 20)) for before, alone, both in terms)))
    return dict(out)


@pytest.mark.parametrize("segment_tokens,chunk_bytes", [(2_000_000, 8_000_000), (500, 3000)])
def test_no_ngram_is_dropped_however_small_the_filter_begins(spark, monkeypatch, segment_tokens, chunk_bytes):
    monkeypatch.setattr(language_model, "CHUNK_BYTES", chunk_bytes, raising=False)
    picked = random.Random(3)
    data = [(i, " ".join(f"w{int(picked.paretovariate(0.6)) % 5000}" for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    want = brute_score(data)
    wide = {r.doc_id: r.score for r in language_model_scores(docs, filter_bits=1 << 26, segment_tokens=segment_tokens).collect()}
    assert wide == pytest.approx(want, rel=1e-6)
    tight = {r.doc_id: r.score for r in language_model_scores(docs, filter_bits=1 << 10, segment_tokens=segment_tokens).collect()}
    assert sum(abs(tight[i] - want[i]) for i in want) < 0.02 * sum(abs(x) for x in want.values())


def test_scores_without_rows_or_training_rows(spark):
    assert rows(language_model_scores(empty(spark), filter_bits=1 << 16)) == []
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    only = spark.createDataFrame([(i, "some words") for i in held], "doc_id bigint, text string")
    assert all(r[4] == 0 and r[3] == 0 and r[2] == 3 for r in rows(language_model_scores(only, filter_bits=1 << 16)))


def test_filter_reads_back_levels_and_keeps_the_frequent_when_full():
    random = np.random.default_rng(1)
    h, counts = mixed(np.arange(1, 3001, dtype=np.uint64)), random.integers(1, 5000, 3000)
    bloom = LogBloom(4, 1 << 20)
    part = bloom.segment(h)
    bits = np.frombuffer(b"".join(bloom.build(h[part == s], counts[part == s]) for s in range(4)), np.uint8)
    level = bloom.read(bits, h)
    assert (level >= levels_of(counts)).all() and (level == levels_of(counts)).mean() > 0.98
    assert (bloom.read(bits, mixed(np.arange(10_000, 20_000, dtype=np.uint64))) > 0).mean() < 0.02
    value = count_of_level()[levels_of(counts)]
    assert (np.abs(value - counts) <= 0.3 * counts).all()
    small = LogBloom(1, 1 << 12)
    bits = np.frombuffer(small.build(h, counts), np.uint8)
    assert np.unpackbits(bits).mean() < 0.55 and (small.read(bits, h[np.argsort(-counts)[:20]]) >= 10).all()


def test_model_beats_the_word_frequencies_on_held_out_text(spark):
    source = language_model_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert source.score.sum() > source.base_score.sum()


def test_pairs_and_words_have_hashes_apart():
    tokens, sizes = language_model.token_hashes(["a b", ""])
    assert sizes.tolist() == [3, 1] and (tokens & np.uint64(1) == 1).all()
    assert (language_model.pair_hashes(tokens) & np.uint64(1) == 0).all()
