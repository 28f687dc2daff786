"""Column cleaning: names, empty columns, the technical key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.columns import Roles, c, present
from tidegauge.operators.quality import empty_warnings, warning_rows
from tidegauge.plans.sizing import checkpointed

# Names taken as the key without looking at the data, and the uniqueness needed otherwise.
KEY_NAMES = ("unnamed: 0", "index", "id", "record_id", "row_id")
KEY_UNIQUENESS = 0.95
SKETCH_MARGIN = 0.85


def normal_name(name: str) -> str:
    return re.sub(r"\s+", " ", name.replace("\ufeff", "").strip())


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(n) for n in df.columns])


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Remove columns without a single value; one map-side aggregate decides."""
    names = df.columns
    filled = df.agg(*[F.count(present(df, n)).alias(f"f{i}") for i, n in enumerate(names)]).first()
    empty = [n for i, n in enumerate(names) if filled[f"f{i}"] == 0]
    return df.select(*[c(n) for n in names if n not in empty]), empty


def find_key(df: DataFrame) -> str | None:
    """A column with a key-like name, else the first whose values are (nearly all) present and distinct.

    Sketches rule out most columns; exact distinct counts run for the remaining ones in column order.
    """
    for name in df.columns:
        if normal_name(name).lower() in KEY_NAMES:
            return name
    names = df.columns
    row = df.agg(
        F.count("*").alias("n"),
        *[F.count(c(n)).alias(f"f{i}") for i, n in enumerate(names)],
        *[F.approx_count_distinct(c(n), 0.02).alias(f"d{i}") for i, n in enumerate(names)],
    ).first()
    for i, name in enumerate(names):
        filled = row[f"f{i}"]
        if not filled or row[f"d{i}"] < SKETCH_MARGIN * filled or filled / row["n"] <= KEY_UNIQUENESS:
            continue
        distinct = df.select(c(name)).filter(c(name).isNotNull()).distinct().count()
        if distinct == filled and distinct / row["n"] > KEY_UNIQUENESS:
            return name
    return None


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """Dense row numbers from per-partition counts; ids are fixed by a checkpoint before use."""
    names = df.columns
    tagged = checkpointed(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = tagged.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    ahead = Window.orderBy("__part")  # one row per input partition
    starts = sizes.select("__part", (F.sum("__rows").over(ahead) - F.col("__rows")).alias("__start"))
    numbered = tagged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    local = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    return numbered.select(*[c(n) for n in names], (F.col("__start") + local).alias(key))


def clean(df: DataFrame, source: str, roles: Roles = Roles()) -> tuple[DataFrame, list[str], DataFrame]:
    """Normalised names, no empty columns, and the key under its role name.

    Returns the table, the dropped columns and the warnings.
    """
    df, dropped = drop_empty_columns(normalise_names(df))
    key = find_key(df)
    if key is None:
        note = ("index_inferred", "warning", roles.key, f"{source} has no key column; rows were numbered.",
                "Provide a stable unique id for reliable merging.")
        return number_rows(df, roles.key), dropped, warning_rows(df, [note])
    if key != roles.key:
        df = df.withColumnRenamed(key, roles.key)
    return df, dropped, empty_warnings(df)
