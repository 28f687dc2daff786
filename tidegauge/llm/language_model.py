"""Language-model scores from a log-frequency Bloom filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tidegauge.llm.common import checkpointed, numbered, staged, text_of

#: The end token doubles as what stands before the first word; no word holds a line feed.
END = b"\n"
FILTER_BITS = 1 << 28
PROBES = 4
BASE = 1.5
SEGMENT_TOKENS = 2_000_000
MOST_SEGMENTS = 1 << 20
KNOWN_WORDS = 1 << 18
CHUNK_BYTES = 8_000_000
SMOOTHING = 0.1
PRIOR = 20.0
#: log-frequency class of a count, and the counts that a class stands for.
TOP_CLASS = 128


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit function (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py())
        size += len(held[-1]) + 100
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order, and the number of tokens of each; the last bit is 1."""
    words = [[*t.encode().lower().split(), END] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    joined = b"".join([xxh64_digest(w) for doc in words for w in doc])
    return np.frombuffer(joined, ">u8").astype(np.uint64) | np.uint64(1), sizes


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the last bit is 0."""
    before = np.concatenate([token_hashes([""])[0], tokens[:-1]])
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens) & ~np.uint64(1)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64) + 1, TOP_CLASS)


def count_of_level() -> np.ndarray:
    """Mean of the whole counts in each level; level 0 is 0."""
    edges = np.ceil(BASE ** np.arange(TOP_CLASS + 1.0) - 1e-9)
    return np.concatenate([[0.0], np.maximum((edges[:-1] + edges[1:] - 1) / 2, edges[:-1])])


class LogBloom:
    """Bloom filter that holds (n-gram, level) for every level up to the n-gram's own.

    The filter is cut into ``segments`` by the leading bits of the n-gram's hash, each built by
    one task. A count is read by probing level after level until one is missing, so an error
    needs a false positive per level and overstates by few levels.
    """

    def __init__(self, segments: int, bits: int):
        self.segments, self.size = segments, bits // segments

    def segment(self, h: np.ndarray) -> np.ndarray:
        shift = 64 - (self.segments.bit_length() - 1)
        return (h >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(h), np.int64)

    def capacity(self) -> int:
        """Entries of a segment at which half of its bits are set."""
        return int(self.size * np.log(2) / PROBES)

    def spots(self, h: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
        a = mixed(h + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
        b = mixed(a) | np.uint64(1)
        return ((a + np.uint64(probe) * b) & np.uint64(self.size - 1)).astype(np.int64)

    @classmethod
    def holding(cls, counts: np.ndarray, least: int) -> LogBloom:
        """A filter of one segment with room for every n-gram of these counts, of ``least`` bits or more."""
        needed = max(64, least, int(levels_of(counts).sum() * PROBES / np.log(2)) + 1)
        return cls(1, 1 << (needed - 1).bit_length())

    def build(self, h: np.ndarray, counts: np.ndarray) -> bytes:
        """Bits of one segment. Whole classes of equal counts go in, largest first, as far as the capacity reaches;
        a filter made by ``holding`` takes all."""
        levels = levels_of(counts)
        order = np.argsort(-counts, kind="stable")
        h, counts, levels = h[order], counts[order], levels[order]
        used = np.cumsum(levels)
        fit = int(np.searchsorted(used, self.capacity(), side="right"))
        if 0 < fit < len(h):
            fit = int(np.searchsorted(-counts, -counts[fit], side="left"))
        h, levels = h[:fit], levels[:fit]
        bits = np.zeros(self.size, np.bool_)
        for level in range(1, int(levels.max(initial=0)) + 1):
            h, levels = h[levels >= level], levels[levels >= level]
            for probe in range(PROBES):
                bits[self.spots(h, level, probe)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def read(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram."""
        level, rows, start = np.zeros(len(h), np.int64), np.arange(len(h)), self.segment(h) * self.size
        for step in range(1, TOP_CLASS + 1):
            for probe in range(PROBES):
                spot = start[rows] + self.spots(h[rows], step, probe)
                rows = rows[(bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
            if not len(rows):
                break
            level[rows] = step
        return level


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row: a chunk, named by its first row, the bytes of its texts, and its rows as a compressed Arrow stream."""
    rows, sink = pa.Table.from_batches(held), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
        file.write_table(rows)
    return pa.record_batch({
        "chunk": pa.array([rows.column("row")[0].as_py()], pa.int64()),
        "bytes": pa.array([pc.sum(pc.binary_length(rows.column("text"))).as_py()], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
    })


def _unpacked(docs: bytes) -> pa.Table:
    return pa.ipc.open_stream(docs).read_all()


def _chunked(most: int) -> Callable:
    """Rows in packed chunks: neighbours of about ``most`` bytes together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start = 0
            for i, length in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                size += length + 100
                if size > most:
                    yield _packed([*held, batch.slice(start, i + 1 - start)])
                    held, size, start = [], 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield _packed(held)
    return run


def _chunk_grams(segments: int) -> Callable:
    """Of each chunk a row per segment: its distinct n-gram hashes in order, and their counts in training texts (0 for held-out ones)."""
    def rows_of(chunk: int, docs: pa.Table) -> pa.RecordBatch:
        tokens, sizes = zip(*(token_hashes(texts) for texts in text_chunks(docs.column("text"))))
        tokens = np.concatenate(tokens)
        train = np.repeat(~docs.column("held_out").to_numpy().astype(bool), np.concatenate(sizes))
        h, of = np.unique(np.concatenate([tokens, pair_hashes(tokens)]), return_inverse=True)
        c = np.bincount(of, np.tile(train, 2), len(h)).astype("<u4")
        segment = LogBloom(segments, segments).segment(h)
        cuts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        ends = np.append(cuts[1:], len(h))
        return pa.record_batch({
            "chunk": pa.array([chunk] * len(cuts), pa.int64()), "segment": pa.array(segment[cuts], pa.int32()),
            "grams": pa.array([h[a:z].tobytes() for a, z in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([c[a:z].tobytes() for a, z in zip(cuts, ends)], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column("chunk"), batch.column("docs")):
                yield rows_of(chunk.as_py(), _unpacked(docs.as_py()))
    return run


def _answers(least_bits: int) -> Callable:
    """Per segment one row with the exact counts of its words, and for each chunk a row with the levels of the n-grams it asked for.

    The filter of the segment is sized by its counted n-grams, so it holds every one of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for s, chunk, h, c in zip(*(batch.column(k).to_pylist() for k in ("segment", "chunk", "grams", "counts"))):
                held = parts.setdefault(s, ([], [], []))
                held[0].append(chunk)
                held[1].append(np.frombuffer(h, np.uint64))
                held[2].append(np.frombuffer(c, "<u4"))
        for s in sorted(parts):
            chunks, hs, cs = parts.pop(s)
            ends = np.cumsum([len(h) for h in hs])
            h, of = np.unique(np.concatenate(hs), return_inverse=True)
            c = np.bincount(of, np.concatenate(cs), len(h)).astype(np.int64)
            seen = c > 0
            bloom = LogBloom.holding(c[seen], least_bits)
            bits = np.frombuffer(bloom.build(h[seen], c[seen]), np.uint8)
            levels = bloom.read(bits, h).astype(np.uint8)[of]
            word = seen & ((h & np.uint64(1)) == 1)
            yield pa.record_batch({
                "segment": pa.array([s] * (len(chunks) + 1), pa.int32()), "chunk": pa.array([None, *chunks], pa.int64()),
                "levels": pa.array([None, *(x.tobytes() for x in np.split(levels, ends[:-1]))], pa.binary()),
                "words": pa.array([h[word].tobytes(), *[None] * len(chunks)], pa.binary()),
                "word_counts": pa.array([c[word].tobytes(), *[None] * len(chunks)], pa.binary()),
            })
    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, c in zip(batch.column("words").to_pylist(), batch.column("word_counts").to_pylist()):
            yield pa.record_batch({"h": pa.array(np.frombuffer(h, np.int64)), "c": pa.array(np.frombuffer(c, np.int64))})


def _score(model: object) -> Callable:
    """Score of the texts of a chunk and the part of the base score that the known words give; other tokens are handed on with their number."""
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unpacked(chunk.column("docs")[0].as_py())
        m, value = model.value, count_of_level()
        denominator = m["tokens"] + SMOOTHING * (m["vocabulary"] + 1)
        # Segments are leading bits, so answers in order of segments belong to the chunk's n-grams in order of hashes.
        answers = answers.sort_by("segment")
        parts = [token_hashes(texts) for texts in text_chunks(docs.column("text"))]
        grams = np.unique(np.concatenate([x for tokens, _ in parts for x in (tokens, pair_hashes(tokens))]))
        levels = np.concatenate([np.frombuffer(x, np.uint8) for x in answers.column("levels").to_pylist()])
        if len(levels) != len(grams):
            raise ValueError(f"{len(levels)} answers for {len(grams)} n-grams")
        count = lambda h: value[levels[np.searchsorted(grams, h)]]
        out: dict[str, list] = {k: [] for k in ("n_tokens", "known", "base", "score", "others", "times")}
        for tokens, sizes in parts:
            doc = np.repeat(np.arange(len(sizes)), sizes)
            words, word_of = np.unique(tokens, return_inverse=True)
            found = np.minimum(np.searchsorted(m["words"], words), max(len(m["words"]) - 1, 0))
            hit = m["words"][found] == words if len(m["words"]) else np.zeros(len(words), bool)
            exact = np.where(hit, m["counts"][found] if len(m["words"]) else 0, 0)
            base = np.where(hit, np.log10((exact + SMOOTHING) / denominator), 0.0)
            about = count(words)
            single = (about + SMOOTHING) / denominator
            pairs, pair_of = np.unique(pair_hashes(tokens), return_inverse=True)
            together = count(pairs)[pair_of]
            before = np.concatenate([count(token_hashes([""])[0]), about[word_of][:-1]])
            p = (np.minimum(together, before) + PRIOR * single[word_of]) / (before + PRIOR)
            total = lambda x: np.bincount(doc, x, len(sizes))
            out["n_tokens"] += sizes.tolist()
            out["known"] += total(hit[word_of]).astype(np.int64).tolist()
            out["base"] += total(base[word_of]).tolist()
            out["score"] += total(np.log10(p)).tolist()
            left = ~hit[word_of]
            keys, times = np.unique(np.stack([doc[left], word_of[left]]), axis=1, return_counts=True)
            cuts = np.searchsorted(keys[0], np.arange(len(sizes) + 1))
            others = words[keys[1]].view(np.int64)
            out["others"] += [others[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
            out["times"] += [times[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        longs = pa.list_(pa.int64())
        return pa.table({
            "__row": docs.column("row"), "id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "known": pa.array(out["known"], pa.int64()), "base": pa.array(out["base"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
            "others": pa.array(out["others"], longs), "times": pa.array(out["times"], longs),
        })
    return run


def fold(id_value: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_value.cast("string"), F.lit("")).cast("binary")) % folds


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, filter_bits: int = FILTER_BITS,
                          known_words: int = KNOWN_WORDS, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    1. Texts are written in packed chunks of about 8 MB. Each chunk sends every segment of the hash space its distinct
       words and word pairs, packed, with their counts in the training texts (fold not 0). A task per segment sums them,
       builds a log-frequency Bloom filter sized by what it counted, so that no n-gram is dropped, and
       sends each chunk the levels it asked for. Segments grow in number with the corpus, so a task's memory stays the
       same. ``filter_bits`` is the least size of all filters together.
    2. ``score`` is the log10 probability of the text: a word's count after its predecessor, read from the
       filters, smoothed with ``PRIOR`` virtual counts spread by the words' own smoothed frequency.
    3. ``base_score`` needs exact counts. Words above a count that at most ``known_words`` reach are
       broadcast (12 bytes each); the tokens left over join the other words' counts by a shuffle.

    Hashes have 63 bits. A null text is empty and has the end token alone. A null id falls in the fold of
    the empty text. Repeated rows each count and each give a row. Without training rows all counts are 0. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), (fold(F.col(id_col), folds) == 0).alias("held_out"))
    id_type = source.schema["id"].dataType.simpleString()
    texts = staged(numbered(source, "row").mapInArrow(_chunked(CHUNK_BYTES), "chunk bigint, bytes bigint, docs binary"))
    bytes_read = texts.agg(F.sum("bytes")).first()[0] or 0
    wanted = max(1, min(MOST_SEGMENTS, bytes_read // (6 * segment_tokens)))
    segments = 1 << (wanted.bit_length() - 1 + (wanted & (wanted - 1) > 0))
    grams = texts.select("chunk", "docs").mapInArrow(_chunk_grams(segments), "chunk bigint, segment int, grams binary, counts binary")
    built = staged(grams.repartitionById(segments, F.col("segment")).mapInArrow(
        _answers(filter_bits // segments), "segment int, chunk bigint, levels binary, words binary, word_counts binary"))
    counts = checkpointed(built.where(F.col("chunk").isNull()).select("words", "word_counts").mapInArrow(_words, "h bigint, c bigint"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, vocabulary = total["n"] or 0, total["v"]

    doubling = F.floor(F.log2("c")).cast("int").alias("class")
    classes = sorted(counts.groupBy(doubling).count().collect(), reverse=True)
    least, held = 2.0**63, 0
    for k, size in classes:
        held += size
        if held > known_words:
            break
        least = 2.0**k
    known = counts.where(F.col("c") >= least).toArrow()
    words = known.column("h").to_numpy().view(np.uint64) if known.num_rows else np.empty(0, np.uint64)
    order = np.argsort(words)
    model = spark.sparkContext.broadcast({
        "tokens": tokens, "vocabulary": vocabulary,
        "words": words[order], "counts": (known.column("c").to_numpy() if known.num_rows else np.empty(0, np.int64))[order],
    })
    answers = built.where(F.col("chunk").isNotNull()).select("chunk", "segment", "levels")
    scored = checkpointed(texts.select("chunk", "docs").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(model), (
        f"__row bigint, id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, score double, others array<bigint>, times array<bigint>")))
    loose = scored.select("__row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("__row", F.col("o.others").alias("h"), F.col("o.times").alias("times"))
    rest = counts.where(F.col("c") < least)
    c = F.coalesce("c", F.lit(0))
    log = F.log10((c + SMOOTHING) / F.lit(tokens + SMOOTHING * (vocabulary + 1)))
    per_row = loose.join(rest, "h", "left").groupBy("__row").agg(
        F.sum(F.col("times") * log).alias("more_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    return scored.join(per_row, "__row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
