"""Delimited text: format sniffing and a reader that keeps every column as text."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.columns import c, to_number

# Separators in order of preference and the cell texts read as missing.
SEPARATORS = (",", ";", "\t", "|")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SPARK_ENCODINGS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
SENTINEL = "__beyond_header"


@dataclass(frozen=True)
class Delimited:
    encoding: str
    separator: str
    columns: tuple[str, ...]


def _names(cells: list[str]) -> tuple[str, ...]:
    """Header cells as unique names: blanks numbered, repeats suffixed."""
    seen: dict[str, int] = {}
    names = []
    for position, cell in enumerate(cells):
        name = cell if cell != "" else f"Unnamed: {position}"
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        names.append(f"{name}.{repeat}" if repeat else name)
    return tuple(names)


def sniff(spark: SparkSession, path: str) -> Delimited:
    """Encoding from a distributed validity scan of all bytes; separator from the header line.

    The separator giving the most columns wins, unnamed columns counting slightly less and ties
    going to the earlier separator.
    """
    text = spark.read.text(path)
    broken = text.filter(~F.is_valid_utf8("value")).take(1)
    encoding = "latin-1" if broken else "utf-8"
    line = F.decode(F.col("value").cast("binary"), SPARK_ENCODINGS[encoding]).alias("line")
    first = text.select(line).filter(F.trim("line") != "").take(2)
    if not first:
        raise ValueError(f"Could not parse delimited file '{path}': it is empty")
    header, has_rows = first[0]["line"], len(first) > 1
    best, best_score = None, -1
    for separator in SEPARATORS:
        names = _names(next(csv.reader([header], delimiter=separator)))
        if not has_rows and len(names) <= 1:
            continue
        score = 10 * len(names) - sum(n.lower().startswith("unnamed") for n in names)
        if score > best_score:
            best, best_score = Delimited(encoding, separator, names), score
    if best is None:
        raise ValueError(f"Could not parse delimited file '{path}'")
    return best


def read_delimited(
    spark: SparkSession, path: str, form: Delimited | None = None, multi_line: bool = False
) -> DataFrame:
    """All-text table. Rows longer than the header are dropped, shorter rows are padded with NULL."""
    form = form or sniff(spark, path)
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(len(form.columns))]
    raw = (
        spark.read.option("header", True)
        .option("sep", form.separator)
        .option("encoding", SPARK_ENCODINGS[form.encoding])
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .schema(T.StructType([*fields, T.StructField(SENTINEL, T.StringType())]))
        .csv(path)
        .filter(F.col(SENTINEL).isNull())
    )
    return raw.select(
        *[
            F.when(~F.col(f"f{i}").isin(*NA_TOKENS), F.col(f"f{i}")).alias(name)
            for i, name in enumerate(form.columns)
        ]
    )


def read_report(df: DataFrame, path: str, form: Delimited) -> DataFrame:
    """File name, encoding, separator and shape of one read."""
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("filename"),
        F.lit(form.encoding).alias("encoding"),
        F.lit(form.separator).alias("separator"),
        "n_rows",
        F.lit(len(form.columns)).alias("n_columns"),
    )


def read_saved_text(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """Reload a saved text table under its saved types: numbers are coerced, the rest stays text."""
    df = read_delimited(spark, path)
    numeric = ("int", "long", "short", "byte", "float", "double", "decimal")
    return df.select(
        *[
            (to_number(c(n)) if any(t in types.get(n, "string") for t in numeric) else c(n)).alias(n)
            for n in df.columns
        ]
    )
