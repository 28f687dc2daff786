"""Distributed order statistics: ranks, quantiles and medians that never sort in one task.

The value axis is cut at sketched quantiles. The cuts only balance the work, every result is exact.
``quantiles`` counts rows per slice first and then looks at the few slices that hold a wanted rank.
``ordered_counts`` ranks everything: equal values collapse to one row (map-side combined), prefix sums
run per slice and only slice totals meet. A hot group spreads over the slices, a hot value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.columns import c
from tidegauge.plans.sizing import BROADCAST_ROWS, UNKNOWN_BYTES, estimated_bytes, is_small, is_tiny

FEW_SLICES, MANY_SLICES = 256, 8_192
SKETCH_BYTES = 4 * 1024**3
SKETCH_SEED = 17


def _slice_points(df: DataFrame, value: str) -> list[float]:
    """Balanced cut points. Very large inputs place them from a row sample; results do not depend on it."""
    size = estimated_bytes(df)
    slices = FEW_SLICES if is_small(df) else MANY_SLICES
    if SKETCH_BYTES < size < UNKNOWN_BYTES:
        df = df.sample(SKETCH_BYTES / size, seed=SKETCH_SEED)
    cuts = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(c(value), cuts, 2 * slices).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def _sliced(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    if not points:
        return df.withColumn("__slice", F.lit(0.0))
    edges = [-float("inf"), *points, float("inf")]
    return Bucketizer(splits=edges, inputCol=value, outputCol="__slice").transform(df)


def _same(by: Sequence[str], *more: str) -> Column:
    """Null-safe equality of the group keys of the sides ``l`` and ``r``."""
    condition = F.lit(True)
    for key in (*by, *more):
        condition = condition & F.col(f"l.`{key}`").eqNullSafe(F.col(f"r.`{key}`"))
    return condition


def ordered_counts(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """One row per distinct ``(by, value)`` with ``n``, the rows ``before`` it and the group ``total``."""
    by = list(by)
    rows = df.filter(c(value).isNotNull())
    counted = F.sum(c(weight)) if weight else F.count("*")
    keys = [c(k) for k in by]
    counts = rows.groupBy(*keys, c(value)).agg(counted.cast("bigint").alias("n"))
    if small is None:
        small = is_small(rows)
    points = [] if small else _slice_points(rows, value)
    counts = _sliced(counts, value, points)
    within = Window.partitionBy(*keys, "__slice").orderBy(c(value)).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("__inside", F.sum("n").over(within) - F.col("n"))
    if not points:
        whole = Window.partitionBy(*keys, "__slice")
        return running.select(
            *keys, c(value), "n", F.col("__inside").alias("before"), F.sum("n").over(whole).alias("total")
        )
    slices = counts.groupBy(*keys, "__slice").agg(F.sum("n").alias("__rows"))
    earlier = Window.partitionBy(*keys).orderBy("__slice")
    offsets = slices.select(
        *keys,
        "__slice",
        (F.sum("__rows").over(earlier) - F.col("__rows")).alias("__offset"),
        F.sum("__rows").over(Window.partitionBy(*keys)).alias("total"),
    )
    return running.alias("l").join(offsets.alias("r"), _same(by, "__slice")).select(
        *[F.col(f"l.`{k}`").alias(k) for k in by],
        F.col(f"l.`{value}`").alias(value),
        F.col("l.n").alias("n"),
        (F.col("l.__inside") + F.col("r.__offset")).alias("before"),
        F.col("r.total").alias("total"),
    )


def average_rank() -> Column:
    """Tie-averaged rank of a row of ``ordered_counts``."""
    return F.col("before") + (F.col("n") + 1) / 2.0


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per named probability."""
    by = list(by)
    keys = [c(k) for k in by]
    names, points = list(probs), list(probs.values())
    rows = df.filter(c(value).isNotNull())
    if small is None:
        small = is_small(rows)
    if small and is_tiny(rows):
        literal = F.array(*[F.lit(float(p)) for p in points])
        every = (
            F.percentile(c(value).cast("double"), literal, c(weight))
            if weight
            else F.percentile(c(value).cast("double"), literal)
        )
        found = rows.groupBy(*keys).agg(every.alias("__q"))
        return found.select(*keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(names)])
    ordered = _narrowed(rows, by, value, points, weight)
    if ordered is None:
        ordered = ordered_counts(rows, by, value, weight, small=False)
    aggregates = []
    for i, p in enumerate(points):
        for suffix, rank in zip(("lo", "hi"), _ranks(p)):
            hit = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            aggregates.append(F.max(F.when(hit, c(value).cast("double"))).alias(f"__{suffix}{i}"))
    picked = ordered.groupBy(*keys).agg(F.max("total").alias("__total"), *aggregates)
    results = []
    for i, (name, p) in enumerate(probs.items()):
        position = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        results.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *results)


def _ranks(p: float) -> tuple[Column, Column]:
    position = (F.col("total") - 1) * F.lit(float(p))
    return F.floor(position), F.ceil(position)


def _narrowed(
    rows: DataFrame, by: list[str], value: str, probs: Sequence[float], weight: str | None
) -> DataFrame | None:
    """Ordered counts of just the slices that hold a wanted rank; None when they are too many to broadcast."""
    keys = [c(k) for k in by]
    counted = (F.sum(c(weight)) if weight else F.count("*")).cast("bigint")
    sliced = _sliced(rows.select(*keys, c(value), *([c(weight)] if weight else [])), value, _slice_points(rows, value))
    totals = sliced.groupBy(*keys, "__slice").agg(counted.alias("__rows"))
    earlier = Window.partitionBy(*keys).orderBy("__slice")  # one row per slice
    placed = totals.select(
        *keys, "__slice", "__rows", (F.sum("__rows").over(earlier) - F.col("__rows")).alias("__offset"),
        F.sum("__rows").over(Window.partitionBy(*keys)).alias("total"),
    )
    wanted = F.lit(False)
    for p in probs:
        for rank in _ranks(p):
            wanted = wanted | ((F.col("__offset") <= rank) & (rank < F.col("__offset") + F.col("__rows")))
    targets = placed.filter(wanted).drop("__rows").persist()
    if targets.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    inside = sliced.alias("l").join(F.broadcast(targets).alias("r"), _same(by, "__slice")).select(
        *[F.col(f"l.`{k}`").alias(k) for k in by], F.col(f"l.`{value}`").alias(value),
        *([F.col(f"l.`{weight}`").alias(weight)] if weight else []), "l.__slice", "r.__offset", "r.total",
    )
    counts = inside.groupBy(*keys, "__slice", "__offset", "total", c(value)).agg(counted.alias("n"))
    within = Window.partitionBy(*keys, "__slice").orderBy(c(value)).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("before", F.col("__offset") + F.sum("n").over(within) - F.col("n"))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
