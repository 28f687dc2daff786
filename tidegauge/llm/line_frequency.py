"""Quality rules: lines that many documents of a host share are removed, depleted documents rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, broadcast_if_small, checkpointed, let, numbered, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
NO_LONGS = "array<bigint>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, x: total + x)


def _covered(starts: Column) -> Column:
    """Words in windows of eight that begin at the sorted ``starts``."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), p - F.coalesce(F.get(starts, k - 1), p - WINDOW)))
    return _sum(steps.cast(NO_LONGS))


def _repeat_words(words: Column) -> Column:
    """Words in windows found twice or more: windows are hashed, and sorted only where a hash repeats."""
    last = F.size(words) - (WINDOW - 1)
    hashes = F.when(
        last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    ).otherwise(F.array().cast(NO_LONGS))

    def sorted_starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda p, k: F.coalesce(p.x == F.get(s, k - 1).x, F.lit(False))
                     | F.coalesce(p.x == F.get(s, k + 1).x, F.lit(False))),
            lambda p: p.i)))

    return let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")
    ).otherwise(let(sorted_starts(h), _covered)))


def _tidy(text: Column) -> Column:
    """Normal form in which lines are compared: lower case, one space between words."""
    return F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")


def _text_hash(text: Column) -> Column:
    """64 bits of the text's MD5 in hex."""
    return F.substring(F.md5(text), 1, 16)


def _line_hashes(text: Column) -> Column:
    """(hash, words) of every line with a word, in order."""
    lines = F.filter(F.transform(F.split(_tidy(text), "\n"), lambda line: F.trim(line)), lambda line: line != "")
    return F.transform(lines, lambda line: F.struct(
        F.xxhash64(line).alias("line"), F.size(F.split(line, " ")).cast("bigint").alias("words")))


def text_measures(text: Column) -> Column:
    """Struct of the base measures of one whole text."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    per_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        _sum(F.transform(w, lambda x: F.length(x).cast("bigint"))).alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
    ))
    return let(per_words, lambda m: F.struct(
        m.n_words.alias("n_words"), m.word_chars.alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        dup_lines.cast("bigint").alias("n_dup_lines"), m.n_repeat_words.alias("n_repeat_words"),
    ))


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = 10,
                   host_share: float = 0.01, max_docs: int = 100) -> DataFrame:
    """(host, line, first_text): lines in too many distinct documents of a host.

    The limit is ``host_share`` of the host's distinct documents, but at least ``min_docs`` and at most
    ``max_docs``, so that the bar doesn't rise with a hot host. A line goes when it is in more documents than that.

    Documents with the same text count once, so copies alone make no line frequent. Rows are
    distinct by (host, line, text) before they meet by line, so one very common line is summed
    from partial counts. ``first_text`` is the smallest text hash that holds the line.
    """
    text = text_of(text_col)
    base = docs.select(F.col(host_col).alias("host"), _text_hash(text).alias("text_hash"), _line_hashes(text).alias("lines"))
    lines = base.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x.line))).alias("line")).distinct()
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("text_hash").alias("first_text")).where(F.col("docs") > min(min_docs, max_docs))
    hosts = (
        docs.select(F.col(host_col).alias("host"), _text_hash(text).alias("text_hash")).distinct()
        .groupBy("host").agg(F.count("*").alias("host_docs"))
    )
    limit = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), host_share * F.col("host_docs")))
    return counted.join(hosts, counted.host.eqNullSafe(hosts.host)).where(F.col("docs") > limit).select(
        counted.host, "line", "first_text"
    )


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 min_docs: int = 10, host_share: float = 0.01, max_docs: int = 100, min_left: float = 0.3,
                 with_text: bool = False) -> DataFrame:
    """One row per input row with base measures, removed words and the verdict ``kept``.

    Lines found in more distinct documents of their host than its limit (``host_share`` of its distinct documents, at
    least ``min_docs`` and at most ``max_docs``) are removed, except from the document that holds them first
    (smallest text hash). A document is rejected if a base rule fails (under 20 words, or over 30 % of
    its words in repeated windows), or as depleted if under ``min_left`` of its words are left.
    ``with_text`` adds ``clean_text``, the text without removed lines.

    A null text has no words and fails the base rule. A null host is a host of its own. Repeated
    rows each give a row. An empty table gives an empty result. Other columns are not read. A very long text
    is one row: its words and line hashes are arrays of one task's memory, about three times its size.
    """
    frequent = checkpointed(frequent_lines(docs, host_col, text_col, min_docs, host_share, max_docs))
    text = text_of(text_col)
    rows = numbered(docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), _text_hash(text).alias("text_hash"),
        text_measures(text).alias("m"), _line_hashes(text).alias("lines"), *([text.alias("text")] if with_text else []),
    ))
    carried = [F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("text")).alias("text")] if with_text else []
    lines = rows.select("__row", "id", "host", "text_hash", "m", *(["text"] if with_text else []), F.posexplode_outer("lines").alias("pos", "l")).select(
        "__row", "id", "host", "text_hash", "m", F.col("l.line").alias("line"), F.col("l.words").alias("words"), *carried
    )
    seen = broadcast_if_small(frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), "first_text"), 128)
    marked = lines.join(
        seen, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")) & (F.col("text_hash") != F.col("first_text")), "left"
    )
    gone = F.when(F.col("f_line").isNotNull(), F.col("words")).otherwise(0)
    extra = [F.collect_set("f_line").alias("gone"), F.first("text", ignorenulls=True).alias("text")] if with_text else []
    per_doc = marked.groupBy("__row").agg(F.first("id").alias("id"), F.first("m").alias("m"), F.sum(gone).alias("n_removed_words"), *extra)
    n, left = F.col("m.n_words"), F.col("m.n_words") - F.col("n_removed_words")
    failed = (n < 20) | (100 * F.col("m.n_repeat_words") > 30 * n)
    clean = F.array_join(F.filter(
        F.split("text", "\n"), lambda line: ~F.array_contains(F.col("gone"), F.xxhash64(F.trim(_tidy(line))))), "\n")
    return per_doc.select(
        F.col("id").alias(id_col), "m.*", "n_removed_words", failed.alias("base_failed"),
        (~failed & (left >= min_left * n)).alias("kept"),
        *([clean.alias("clean_text")] if with_text else []),
    )
