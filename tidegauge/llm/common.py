"""Helpers shared by the operators: stages on shared storage, row ids, size-checked joins, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans.sizing import checkpointed, shared_path

__all__ = [
    "SPACE", "WORD", "broadcast_if_small", "checkpointed", "columns_of", "components", "let", "numbered", "shared_path",
    "staged", "table", "text_of", "unused", "words_of",
]

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Most bytes of a broadcast side; beyond it the join shuffles.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text; white space is space and tab to carriage return only."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """Each row with an id of its own. Ids may differ between runs: write the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows of at most ``row_bytes`` stay in the bound.

    Callers pass stages already written, so that counting is a read of file footers.
    """
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _mark(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating star rounds: ``node`` and ``root``, its smallest reachable node.

    ``edges`` has long columns ``a`` and ``b``. Every round moves links towards smaller nodes, as
    grouped minima and joins, and is written to shared storage. It ends when a round changes
    nothing. Nodes without an edge are absent.
    """
    edges = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        # Large star: larger neighbours of a node link to the smallest node around it.
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours of a node, and itself, link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select("a", "b", "m")
            .select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
            .where("a <> b").distinct()
        )
        edges, last = checkpointed(small), mark
        mark = _mark(edges)
        if mark == last:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names after ``stems`` that no column of ``df`` has."""
    taken = {name.lower() for name in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out


def staged(df: DataFrame) -> DataFrame:
    """``checkpointed`` with stronger compression, for wide payloads."""
    path = shared_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
