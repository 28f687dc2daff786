"""Small tables with the awkward cases every operator has to bear."""

from __future__ import annotations

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h int, size int, `odd.name` string"
#: Names that operators use inside, among them.
EXTRA = ("x", 1, 2, "y")

PLAIN = "The quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees near the quiet river bank at night"
GERMAN = "Der schnelle braune Fuchs springt über den faulen Hund während sieben weise Eulen von alten Eichen am ruhigen Flussufer zusehen"


def awkward_rows():
    long_text = " ".join(f"word{i % 977} other{i % 83}" for i in range(12_000))
    rows = [
        (1, PLAIN, "en", "a", 1), (2, PLAIN, "en", "a", 1), (3, PLAIN.replace(" ", "\t\n "), "en", "b", 1),
        (4, "", "en", "a", 0), (5, None, None, None, None), (None, GERMAN, "de", "b", 3), (6, long_text, "en", "a", 9),
        (7, "one", "en", "c", 1), (8, " \t\r\n\x0b\x0c ", "en", "c", 1), (9, GERMAN, "de", "b", 1), (9, GERMAN, "de", "b", 1),
        (10, "x" * 50_000, "en", "a", 1), (11, "a\nb b\na\nc\n\na b \U0001f600", "en", "a", 1), (-12, PLAIN + " indeed", "en", "b", 1),
    ]
    return [(*r, *EXTRA) for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
