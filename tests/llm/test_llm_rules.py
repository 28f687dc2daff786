"""Quality rules, mixing, language, toxicity and WARC on awkward tables, against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frames import GERMAN, PLAIN, awkward, awkward_rows, empty, rows
from tidegauge.llm import warc
from tidegauge.llm.language_id import accepted_documents, document_evidence, identify, page_evidence, text_model
from tidegauge.llm.line_frequency import line_quality
from tidegauge.llm.mixing import mix, mixed_documents, source_targets
from tidegauge.llm.toxicity import fitting_rows, toxicity_scores


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = defaultdict(int)
    for w in windows:
        seen[w] += 1
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_base_measures_match_brute_force(spark):
    texts = [r[1] for r in awkward_rows()] + ["a b c d e f g h " * 5, "# * $ %% && || <<>>\n# * $ %% && || <<>>", "x y " * 9 + "q " + "x y " * 9]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {r.doc_id: r for r in line_quality(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        n, chars, symbols, dups, repeated = brute_measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
    assert line_quality(awkward(spark)).count() == len(awkward_rows())
    assert rows(line_quality(empty(spark))) == []


def test_lines_of_many_documents_go_and_depleted_documents_are_rejected(spark):
    def body(i):
        return " ".join(f"own{i}x{k}" for k in range(40))
    common = "subscribe to our letter and read more news of this kind every day of the week at no cost whatsoever dear reader"
    data = [(i, f"{body(i)}\n{common.upper()}", "h") for i in range(30)] + [(100, f"few words\n  {common} ", "h")]
    data += [(200 + i, f"{body(7)}\nsame copy", "h") for i in range(30)] + [(300, f"{body(300)}\n{common}", None)]
    docs = spark.createDataFrame(data, "doc_id int, text string, source string")
    got = {r.doc_id: r for r in line_quality(docs, with_text=True).collect()}
    size = len(common.split())
    assert sorted(got[i].n_removed_words for i in [*range(30), 100]) == [0] + [size] * 30
    assert got[100].n_removed_words == size and not got[100].kept and not got[100].base_failed and got[100].clean_text == "few words"
    assert all(got[i].kept for i in [*range(30), *range(200, 230), 300])
    assert got[300].n_removed_words == 0 and all(got[200 + i].n_removed_words == 0 for i in range(30))


def test_limit_of_a_hot_host_does_not_rise_with_it(spark):
    """One host of 60,000 distinct texts: a line in 500 goes, one in exactly 100 stays; one in 20 goes from a small host."""
    i = F.col("id")
    text = F.concat_ws(
        "\n", F.concat(F.lit("own words of document "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.concat(F.lit("w"), i, F.lit("x"), k)), " ")),
        F.when(i % 120 == 0, "all rights of this page are reserved"), F.when(i % 600 == 1, "a rarer line of the same host"))
    small = spark.range(900_000, 900_300).select(
        i.alias("doc_id"), F.concat(F.lit("tiny "), i, F.when(i % 15 == 0, "\nfooter of a small host").otherwise("")).alias("text"), F.lit("small").alias("source"))
    docs = spark.range(60_000).select(i.alias("doc_id"), text.alias("text"), F.lit("hot").alias("source")).unionByName(small)
    got = line_quality(docs).where("n_removed_words > 0").selectExpr("doc_id", "n_removed_words AS n").collect()
    hot, few = [r for r in got if r.doc_id < 900_000], [r for r in got if r.doc_id >= 900_000]
    assert len(hot) == 499 and all(r.doc_id % 120 == 0 and r.n == 7 for r in hot)
    assert len(few) == 19 and all(r.doc_id % 15 == 0 and r.n == 5 for r in few)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = sum(weight[s] for s in open_)
        over = [s for s in open_ if 3 * sizes[s] < left * weight[s] / share]
        if not over:
            return out | {s: left * weight[s] / share for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(out[s] for s in out)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1000, "b": 1, "c": 2, None: 10}, {"a": 5, "b": 5, "c": 5}, {"x": 0, "y": 0}, {"q": 7}, {"a": 0, "Z": 3, "é": 900, "b": 20, None: 0},
])
def test_targets_are_shared_as_the_rounds_would(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_meets_targets_in_whole_epochs_first(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mix(docs, slice_rows=7).collect()
    assert len(got) == docs.count()
    taken, target = defaultdict(int), {}
    sources = dict(docs.select("doc_id", "source").collect())
    for r in got:
        epochs = int(r.target / r.source_size)
        assert epochs * r["size"] <= r.taken <= min(epochs + 1, 3) * r["size"]
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mix(docs.repartition(5), slice_rows=1000)
    assert rows(again.select("doc_id", "taken")) == sorted(((r.doc_id, r.taken) for r in got), key=str)


def test_heavier_documents_come_in_more_often(spark):
    rows_ = [(i, ("words of letters only" if i % 2 else "12 34 56 78"), "a") for i in range(4000)] + [(9999, "z " * 20, "b")]
    got = mix(spark.createDataFrame(rows_, "doc_id int, text string, source string")).where("doc_id < 4000").collect()
    part = [r.taken / r["size"] % 1 for r in got]
    assert got and sum(r.taken for r in got if r.doc_id % 2) > sum(r.taken for r in got if not r.doc_id % 2), part[:3]


def test_mix_of_awkward_documents(spark):
    got = mix(awkward(spark))
    assert got.count() == len(awkward_rows()) and got.where("taken > 3 * size or taken < 0 or size is null").count() == 0
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 1 for r in sums)
    assert rows(mix(empty(spark))) == []
    docs = awkward(spark).withColumn("mixed_key", F.lit(1))
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.groupBy("text").count().where("count > 9").count() == 0
    assert mixed_documents(empty(spark)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unlabelled = document_evidence(docs).withColumn("declared", F.lit(None).cast("string"))
    found = identify(unlabelled, text_model(docs)).withColumnRenamed("id", "doc_id").join(docs, "doc_id")
    held = found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    assert held.where("language = lang").count() >= 0.95 * held.count() > 0


def test_evidence_decides_where_the_text_says_little(spark):
    rows_ = [(i, GERMAN if i % 2 else PLAIN, "de" if i % 2 else "en-GB", "de" if i % 2 else "uk", "d.de" if i % 2 else "e.uk", f"h{i % 2}.x") for i in range(60)]
    rows_ += [(100, "la", None, "de", "d.de", "h1.x"), (101, "la", "en", None, None, None), (102, "la", None, None, None, "h0.x"), (103, "12 34!", "de", "de", "d.de", "h1.x"),
              (104, None, "de", None, None, None), (105, GERMAN, "en", "uk", "e.uk", "h0.x"), (None, GERMAN, None, None, None, None)]
    frame = spark.createDataFrame(rows_, "id int, text string, declared string, suffix string, domain string, host string")
    train = spark.createDataFrame([(i, GERMAN if i % 2 else PLAIN, "de" if i % 2 else "en") for i in range(60)], "doc_id int, text string, lang string")
    model = text_model(train)
    got = {r.id: r for r in identify(frame, model).collect()}
    assert len(got) == len(rows_)
    assert (got[100].language, got[101].language, got[102].language) == ("de", "en", "en")
    assert got[103].language is None and not got[103].kept and not got[104].kept
    assert got[105].language == "de" and got[None].language == "de"
    some = identify(frame, model, accepted=["en"])
    assert some.where("kept and language <> 'en'").count() == 0
    assert identify(frame, ([], text_model(empty(spark))[1])).where("kept").count() == 0
    assert identify(frame.limit(0), model).count() == 0


def test_page_evidence_reads_markup_and_address(spark):
    html = "<!doctype html><HTML class=a lang='de-AT'><style>p{}</style><script>if(a<b){}</script><!-- x --><p>Guten&nbsp;Tag</p></html>"
    frame = spark.createDataFrame([(1, "https://User@Sub.Example.co.DE:80/x?y", html), (2, None, None), (3, "nonsense", "<p>a")], "page_id int, url string, html string")
    got = {r.id: r for r in page_evidence(frame).collect()}
    assert (got[1].declared, got[1].suffix, got[1].domain, got[1].host) == ("de-AT", "de", "co.de", "sub.example.co.de")
    assert got[1].text.split() == ["Guten", "Tag"]
    assert got[2].host is None and got[2].text == "" and got[3].suffix is None


def test_accepted_documents_keep_their_columns(spark):
    docs = awkward(spark).withColumn("refused_key", F.lit(1))
    kept = accepted_documents(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    assert not {4, 5, 8} & set(ids) and {1, 2, 3, 6} <= set(ids) and ids.count(9) == 2
    assert accepted_documents(empty(spark)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    right, said, true = ((found.predicted == 1) & (found.toxic == 1)).sum(), (found.predicted == 1).sum(), (found.toxic == 1).sum()
    assert right >= 0.9 * said and right >= 0.6 * true and found.score.between(0, 1).all()


def test_fitting_rows_are_bounded_where_one_id_repeats(spark):
    """Half of all rows under one id, in 300 texts and in one text 300 times."""
    data = [(7, f"text {i}" if i < 300 else "the same", 1) for i in range(600)] + [(100 + i, f"other {i}", 0) for i in range(600)]
    train = spark.createDataFrame(data, "id bigint, text string, label int")
    hashes = train.select("label", F.xxhash64("id", "text").alias("h"))
    for bound, rows_left in ((50, 50), (901, 901), (5000, 901)):
        got = fitting_rows(train, hashes, bound).collect()
        assert len(got) == rows_left and sum(r.text == "the same" for r in got) <= 1
    docs = train.select(F.col("id").alias("doc_id"), "text")
    found = toxicity_scores(docs, train.select(F.col("id").alias("doc_id"), F.col("label").alias("toxic")), fit_rows=50)
    assert found.count() == 1200 and found.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_of_a_wide_and_rare_vocabulary(spark):
    picked = random.Random(5)
    words = ["".join(picked.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(2600)]
    plain, toxic = words[:2000], words[2000:]
    data = [(i, " ".join([*picked.choices(plain, k=40), *(picked.choices(toxic, k=2) if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(4500)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, toxic int").repartition(4)
    found = toxicity_scores(frame.drop("toxic"), frame.drop("text")).join(frame, "doc_id").where("held_out").toPandas()
    right, said, true = ((found.predicted == 1) & (found.toxic == 1)).sum(), (found.predicted == 1).sum(), (found.toxic == 1).sum()
    assert right >= 0.9 * said and right >= 0.9 * true, (right, said, true)


def test_toxicity_of_awkward_tables(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 1, 1), (None, 1, 1), (6, 1, None), (99, 1, 1), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity_scores(docs, marks)
        assert got.count() == len(awkward_rows()) and got.where("score is null or score < 0 or score > 1").count() == 0
    for r in toxicity_scores(docs, labels).collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    assert rows(toxicity_scores(empty(spark), labels)) == []


PAGES = [(1, "http://a.b/c d\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x" * 200_000), (5, "u", "x" * 200_000),
         (-7, "u", "\r\n\r\nWARC/1.1 in a page"), (6, "u", "\r\n\r\nWARC/1.1 in a page")]


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 25])
def test_warc_round_trip_at_any_range_size(spark, tmp_path, range_bytes):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(2)
    got = rows(warc.warc_round_trip(pages, f"file:{tmp_path}/w", range_bytes=range_bytes))
    groups = defaultdict(list)
    for page, _, html in PAGES:
        groups[(html or "").encode()].append(page)
    want = []
    for payload, ids in groups.items():
        first = min(i for i in ids if i is not None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for n, i in enumerate(ids):
            stays = i == first and i not in ids[:n]
            want.append((i, len(payload), digest, "response" if stays else "revisit", None if stays else first))
    assert got == sorted(want, key=str)
    text = b"".join(gzip.open(f"{tmp_path}/w/{name}").read() for name in os.listdir(tmp_path / "w"))
    assert text.count(b"WARC/1.1\r\nWARC-Type:") == len(PAGES) and b"\r\nX: y" not in text


def test_warc_payloads_small_pages_and_false_magic(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    files = warc.write_warc(pages, f"file://{tmp_path}/w", min_revisit_bytes=100)
    found = warc.read_warc(files, with_payload=True)
    assert found.where("record_type = 'revisit'").count() == 1
    assert {bytes(r.payload) for r in found.where("payload is not null").collect()} == {(h or "").encode() for _, _, h in PAGES}
    assert warc.warc_round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0
    noise = b"\x1f\x8b\x08 no member" + gzip.compress(b"not a record") + warc._member(warc.record(8, 0, "u", b"body", hashlib.sha1(b"body").hexdigest(), None)) + b"\x1f\x8b\x08"
    (tmp_path / "noise").write_bytes(noise)
    with open(tmp_path / "noise", "rb") as file:
        found = [warc.parsed(data) for _, data in warc.members(warc._Window(file, len(noise)), 0, len(noise))]
    assert [(f["id"], f["payload"]) for f in found] == [("8", b"body")]


def test_each_range_is_read_by_a_task_of_its_own(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"page {i} " * 30) for i in range(60)], "page_id bigint, url string, html string").repartition(2)
    files = warc.write_warc(pages, f"file:{tmp_path}/many")
    found = warc.read_warc(files, range_bytes=500)
    ranges = files.selectExpr("sum(ceil(size / 500)) AS n").first()["n"]
    assert ranges > 8 and found.rdd.getNumPartitions() == ranges and found.count() == 60
