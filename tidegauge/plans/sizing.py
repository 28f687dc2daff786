"""Size checks that choose between a one-task form and a distributed form of the same result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.columns import c

SMALL_BYTES_KEY = "spark.tidegauge.smallBytes"
SMALL_BYTES = 32 * 1024 * 1024
TINY_BYTES = 8 * 1024 * 1024
UNKNOWN_BYTES = 2**63 - 1
BROADCAST_ROWS = 100_000
HOT_KEYS = 1_000


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate; unknown sizes count as unbounded."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return UNKNOWN_BYTES


def is_small(df: DataFrame) -> bool:
    """True only where the scan below is known to be small enough for one task."""
    limit = int(df.sparkSession.conf.get(SMALL_BYTES_KEY, str(SMALL_BYTES)))
    return estimated_bytes(df) <= limit


def is_tiny(df: DataFrame) -> bool:
    """Small enough to keep every distinct value inside one aggregate buffer."""
    return estimated_bytes(df) <= TINY_BYTES


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the shared checkpoint folder of the session; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-checkpoint-"))
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a shared folder before running iterative operators")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """Fresh folder under the shared checkpoint location of the session."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared checkpoint folder.

    The plan runs once, survives lost executors from here on, and its true size is known.
    """
    path = shared_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialised(df: DataFrame) -> DataFrame:
    """Compute an aggregate once: later reads reuse it and its true size becomes known."""
    df = df.persist()
    df.count()
    return df


def attach(big: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str | None = None) -> DataFrame:
    """Left join a one-row-per-key lookup to row-level data without a hot task.

    A lookup counted at no more than ``BROADCAST_ROWS`` rows is broadcast. A larger one is
    joined in two steps: its heaviest keys (at most ``HOT_KEYS`` rows) are broadcast, and
    the rows they served are spread over the shuffle of the remaining keys.
    """
    on = list(on)
    lookup = lookup.persist()
    if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        payload = lookup.drop(weight) if weight else lookup
        return big.join(F.broadcast(payload), on, "left")
    return _attach_large(big, lookup, on, weight)


def _attach_large(big: DataFrame, lookup: DataFrame, on: list[str], weight: str | None) -> DataFrame:
    values = [name for name in lookup.columns if name not in on and name != weight]
    if weight is None:
        weight = "__w"
        lookup = lookup.join(big.groupBy(*[c(k) for k in on]).agg(F.count("*").alias(weight)), on)
    renamed_hot = [c(v).alias(f"__hot_{v}") for v in values]
    renamed_cold = [c(v).alias(f"__cold_{v}") for v in values]
    hot = (
        lookup.orderBy(F.desc(weight), *[c(k) for k in on])
        .limit(HOT_KEYS)
        .select(*[c(k) for k in on], F.lit(True).alias("__is_hot"), *renamed_hot)
    )
    cold = lookup.select(*[c(k) for k in on], F.lit(0).cast("bigint").alias("__salt"), *renamed_cold)
    spread = F.when(
        F.col("__is_hot"), F.pmod(F.xxhash64(*[c(n) for n in big.columns]), F.lit(1_000_003)) + 1
    ).otherwise(F.lit(0))
    joined = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn("__salt", spread.cast("bigint"))
        .join(cold, [*on, "__salt"], "left")
    )
    picked = [
        F.when(F.col("__is_hot"), c(f"__hot_{v}")).otherwise(c(f"__cold_{v}")).alias(v) for v in values
    ]
    return joined.select(*[c(n) for n in big.columns], *picked)


def rows_of(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn the fields of a one-row aggregate into one row per struct."""
    return one_row.select(F.inline(F.array(*structs)))
