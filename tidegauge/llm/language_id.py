"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, checkpointed, text_of, unused
from tidegauge.llm.language_model import fold

GRAM_BITS = 14
FIT_ROWS_PER_LANGUAGE = 2_000
LEAST_ROWS = 3
GRAM_SMOOTHING = 0.5
#: Text evidence counts as that of so many independent n-grams at most: n-grams overlap and depend on each other.
TEXT_GRAMS = 50
EVIDENCE_SMOOTHING = 5.0
HOST_STRENGTH = 20.0
LEAST_PROBABILITY = 0.5
OTHER_SIGNS = re.compile(r"[\W\d_]+")


def gram_ids(text: str) -> np.ndarray:
    """Bucket of every three-character sequence of the lower-cased letters, words apart by one space."""
    letters = OTHER_SIGNS.sub(" ", text.lower())
    if not letters.strip():
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            sums.setdefault(label, np.zeros(1 << GRAM_BITS, np.int64))[:] += np.bincount(gram_ids(text), minlength=1 << GRAM_BITS)
    for label, counts in sums.items():
        yield pa.record_batch({"label": pa.array([label], pa.string()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, data in zip(batch.column("label").to_pylist(), batch.column("counts").to_pylist()):
            sums.setdefault(label, np.zeros(1 << GRAM_BITS, np.int64))[:] += np.frombuffer(data, np.int64)
    for label, counts in sums.items():
        yield pa.record_batch({"label": pa.array([label], pa.string()), "counts": pa.array([counts.tobytes()], pa.binary())})


def text_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
               rows_per_language: int = FIT_ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, n-gram bucket).

    Fitted on about ``rows_per_language`` labelled rows of each language outside fold 0 of 10 (all where there are fewer),
    those whose hash of id and text lies below the language's share. A language needs ``LEAST_ROWS`` rows.
    """
    text = text_of(text_col)
    rows = docs.where(F.col(label_col).isNotNull() & (fold(F.col(id_col), 10) != 0)).select(
        F.col(label_col).cast("string").alias("label"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h"))
    below = (-(2.0**63) + 2.0**64 * (rows_per_language / F.col("rows"))).cast("bigint")
    borders = checkpointed(
        rows.groupBy(F.col("label").alias("of_label")).agg(F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS)
        .select("of_label", F.when(F.col("rows") <= rows_per_language, F.lit(2**63 - 1)).otherwise(below).alias("border"))
    )
    chosen = rows.join(broadcast_if_small(borders, 128), (F.col("label") == F.col("of_label")) & (F.col("h") <= F.col("border")))
    kind = "label string, counts binary"
    found = chosen.select("label", "text").mapInArrow(_gram_counts, kind).repartition("label").mapInArrow(_summed, kind).collect()
    counts = {r["label"]: np.frombuffer(r["counts"], np.int64) for r in found}
    languages = sorted(counts)
    table = np.array([counts[k] for k in languages], np.float64).reshape(len(languages), 1 << GRAM_BITS) + GRAM_SMOOTHING
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def _likelihoods(table: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, sizes = [], []
            for text in batch.column("text"):
                grams = gram_ids(text.as_py())
                log = table[:, grams].sum(axis=1) * (min(1.0, TEXT_GRAMS / len(grams)) if len(grams) else 0.0)
                logs.append(log - log.max() if len(log) else log)
                sizes.append(len(grams))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            yield pa.record_batch(columns | {"grams": pa.array(sizes, pa.int64()), "logs": pa.array(logs, pa.list_(pa.float64()))})
    return run


def primary_tag(tag: Column) -> Column:
    """`de` of `de-AT` or `DE_at`; null if nothing is declared."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]+)", 1), F.lit(""))


def _soft(counts: Column, n: int) -> Column:
    return F.array(*[F.sum(counts[i]) for i in range(n)])


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], accepted: list[str] | None = None,
             least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """Language of rows with columns id, text, declared, suffix, domain, host; null evidence counts as none.

    1. Each text gives tempered log likelihoods per language; all that follows reads these narrow rows.
    2. Sums of the texts' own posteriors by declared tag, by suffix, by domain and by host give how often a language comes
       with a tag or suffix, and priors: a host's share of a language, pulled towards its
       domain's, which is pulled towards the overall share. A row's own share is taken out of its
       host's and its domain's sums, so that no row confirms itself.
    3. Posterior = text likelihood x P(declared | language) x P(suffix | language) x prior of the host.

    Result: id, language, probability, text_language, kept. Texts without a letter have a null
    language and probability and are rejected; so are those below ``least_probability``, and
    languages outside ``accepted`` if given. Of equal languages the first by name is taken. Without a
    model language everything is rejected. Repeated rows each give a row; an empty table gives an empty result.
    """
    languages, table = model
    n = max(len(languages), 1)
    table = table if len(languages) else np.zeros((1, 1 << GRAM_BITS))
    source = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), primary_tag(F.col("declared")).alias("declared"),
                         *[F.lower(F.col(c)).alias(c) for c in ("suffix", "domain", "host")])
    id_type = source.schema["id"].dataType.simpleString()
    scored = checkpointed(source.mapInArrow(
        _likelihoods(table), f"id {id_type}, declared string, suffix string, domain string, host string, grams bigint, logs array<double>"
    ).withColumn("own", _softmax(F.col("logs"))))
    telling = scored.where("grams > 0")
    overall = (telling.agg(_soft(F.col("own"), n).alias("s")).first()["s"] or [0.0] * n)
    overall = np.array([x or 0.0 for x in overall])
    share = (overall + 1) / (overall + 1).sum()
    known = scored
    for name in ("declared", "suffix", "domain", "host"):
        sums = checkpointed(telling.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"of_{name}")).agg(_soft(F.col("own"), n).alias(f"by_{name}")))
        known = known.join(broadcast_if_small(sums, 512), F.col(name) == F.col(f"of_{name}"), "left")

    def at(name: str, i: int) -> Column:
        return F.coalesce(F.col(name)[i], F.lit(0.0))

    def total(name: str) -> Column:
        return F.coalesce(F.aggregate(F.col(name), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))

    def likelihood(name: str, i: int) -> Column:
        everything = float(overall.sum()) or 1.0
        smooth = EVIDENCE_SMOOTHING * (total(f"by_{name}") / everything)
        value = F.log((at(f"by_{name}", i) + smooth + 1e-9) / F.lit(float(overall[i]) + EVIDENCE_SMOOTHING))
        return F.when(F.col(f"by_{name}").isNotNull(), value).otherwise(0.0)

    self_share = F.when(F.col("grams") > 0, 1.0).otherwise(0.0)

    def pulled(name: str, i: int, towards: Column) -> Column:
        others = F.greatest(at(f"by_{name}", i) - self_share * F.col("own")[i], F.lit(0.0))
        size = F.greatest(total(f"by_{name}") - self_share, F.lit(0.0))
        return F.when(F.col(f"by_{name}").isNotNull(), (others + HOST_STRENGTH * towards) / (size + HOST_STRENGTH)).otherwise(towards)

    fused = [
        F.col("logs")[i] + likelihood("declared", i) + likelihood("suffix", i)
        + F.log(pulled("host", i, pulled("domain", i, F.lit(float(share[i]))))) for i in range(n)
    ]
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array(F.lit(None).cast("string"))
    posterior = known.withColumn("posterior", _softmax(F.array(*fused)))
    some = (F.col("grams") > 0) & F.lit(bool(languages))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    result = posterior.select(
        "id", F.when(some, F.get(names, best - 1)).alias("language"), F.when(some, F.array_max("posterior")).alias("probability"),
        F.when(some, F.get(names, F.array_position("own", F.array_max("own")).cast("int") - 1)).alias("text_language"),
    )
    fine = F.coalesce(F.col("probability") >= least_probability, F.lit(False))
    if accepted is not None:
        fine = fine & F.coalesce(F.col("language").isin(accepted), F.lit(False))
    return result.withColumn("kept", fine)


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows for ``identify``: text without markup, the language the markup declares, and the parts of the address."""
    html = text_of(html_col)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    part = F.split(host, r"\.")
    named = F.when(host != "", host)
    return pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ").alias("text"),
        F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\x22']?([a-z_-]+)", 1).alias("declared"),
        F.when(host != "", F.element_at(part, -1)).alias("suffix"),
        F.when(host != "", F.array_join(F.slice(part, -F.least(F.size(part), F.lit(2)), 2), ".")).alias("domain"),
        named.alias("host"),
    )


def document_evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Rows for ``identify`` from documents: they have a declared language and a host, no address."""
    nothing = F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(declared_col).cast("string").alias("declared"),
                       nothing.alias("suffix"), nothing.alias("domain"), F.col(host_col).cast("string").alias("host"))


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The documents whose language is told: all columns of ``docs``.

    The verdict is looked up by a hash of id, text, declared language and host, so repeated rows share theirs.
    """
    own, of = unused(docs, "own_key", "refused_key")
    keyed = docs.withColumn(own, F.xxhash64(F.col(id_col), text_of(text_col), F.col(declared_col), F.col(host_col)))
    verdict = identify(document_evidence(keyed, own, text_col, declared_col, host_col), text_model(docs, id_col, text_col, declared_col))
    refused = checkpointed(verdict.where(~F.col("kept")).select(F.col("id").alias(of)).distinct())
    return keyed.join(broadcast_if_small(refused, 32), F.col(own) == F.col(of), "left_anti").drop(own)
