"""Most frequent values by a sketch of candidates and one exact count of these alone.

Counting every value of a near-unique column sends nearly every row through the shuffle. Here each task keeps at
most ``counters`` values per column (Misra and Gries: when there are more, all lose the count of the first one over the
bound, and values at zero go). Summaries of batches and of tasks add up. What a task took off in total bounds how often a value it
dropped can occur, so the sums of the summaries settle which values can be among the first ``k``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import as_text, reject_nested
from tidegauge.plans.counts import column_summary, long_text, ranked, top_values, value_counts
from tidegauge.plans.sizing import BROADCAST_ROWS, checkpointed

COUNTERS = 2_048
SUMMARY = "column int, value string, n bigint, cut bigint, n_rows bigint"


def _merged(values: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray, int]:
    """Sums by value, reduced to at most ``counters`` values, and what each of them lost."""
    grouped = pa.table({"v": values, "n": counts}).group_by("v").aggregate([("n", "sum")])
    values, counts = grouped.column("v").combine_chunks(), grouped.column("n_sum").to_numpy()
    if len(counts) <= counters:
        return values, counts, 0
    cut = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
    kept = counts > cut
    return values.filter(pa.array(kept)), counts[kept] - cut, cut


def _summaries(width: int, counters: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = [pa.array([], pa.string())] * width, [np.empty(0, np.int64)] * width
        cuts, rows = [0] * width, 0
        for batch in batches:
            rows += batch.num_rows
            for i in range(width):
                seen = pc.value_counts(pc.drop_null(batch.column(i)).cast(pa.string()))
                both = pa.concat_arrays([values[i], seen.field(0)]), np.concatenate([counts[i], seen.field(1).to_numpy()])
                values[i], counts[i], cut = _merged(*both, counters)
                cuts[i] += cut
        for i in range(width if rows else 0):
            n = len(values[i])
            yield pa.record_batch({
                "column": pa.array([i] * (n + 1), pa.int32()), "value": pa.concat_arrays([values[i], pa.array([None], pa.string())]),
                "n": pa.array([*counts[i], 0], pa.int64()), "cut": pa.array([0] * n + [cuts[i]], pa.int64()),
                "n_rows": pa.array([0] * n + [rows], pa.int64()),
            })
    return run


def candidates(df: DataFrame, columns: Sequence[str], k: int, counters: int = COUNTERS) -> tuple[DataFrame, dict[str, int], list[str]]:
    """Values that can be among the ``k`` most frequent of a column, the rows of the table, and the columns left open.

    A value's count lies between the sum of its summaries and that sum plus all cuts of its column; a value in
    no summary has at most the cuts. So values whose upper bound is under the ``k``-th lower bound are out. A column is left
    open where that ``k``-th lower bound does not exceed the cuts: its values are too alike for ``counters``.
    """
    reject_nested(df, columns)
    names = list(columns)
    texts = df.select(*[as_text(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    parts = checkpointed(texts.mapInArrow(_summaries(len(names), counters), SUMMARY))
    totals = {r["column"]: r for r in parts.groupBy("column").agg(F.sum("cut").alias("cut"), F.sum("n_rows").alias("n_rows")).collect()}
    lower = checkpointed(parts.where("value IS NOT NULL").groupBy("column", "value").agg(F.sum("n").alias("n")))
    kth = {r["column"]: r["n"] for r in ranked(lower, ["column"], [F.desc("n"), F.asc("value")], k).groupBy("column").agg(
        F.min("n").alias("n"), F.count("*").alias("found")).where(F.col("found") == k).collect()}
    names_of, limits, open_, rows = [], [], [], {}
    for i, name in enumerate(names):
        rows[name] = totals[i]["n_rows"] if i in totals else 0
        cut = totals[i]["cut"] if i in totals else 0
        if cut and kth.get(i, 0) <= cut:
            open_.append(name)
        elif i in totals:
            names_of.append((i, name))
            limits.append((i, kth.get(i, 0) - cut))
    none = df.sparkSession.createDataFrame([], "column string, value string")
    if not limits:
        return none, rows, open_
    bounds = df.sparkSession.createDataFrame([(i, n, low) for (i, n), (_, low) in zip(names_of, limits)], "column int, name string, low bigint")
    found = lower.join(F.broadcast(bounds), "column").where(F.col("n") >= F.col("low"))
    return found.select(F.col("name").alias("column"), "value"), rows, open_


def top_counts(df: DataFrame, columns: Sequence[str], k: int = 10, counters: int = COUNTERS) -> DataFrame:
    """``(column, value, n, rank, n_rows)``: the ``k`` most frequent values of each column, ties by label, and the rows.

    The same rows as ``top_values(value_counts(...))``. Settled columns count their candidates alone: a second scan, whose shuffle
    holds at most the candidates. Columns left open by the sketch, and all of them if the candidates don't fit a broadcast,
    are counted in full. Missing values are in ``n_rows`` only; a column without values has no row.
    """
    found, rows, open_ = candidates(df, columns, k, counters)
    found = checkpointed(found)
    if found.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        open_ = list(columns)
    settled = [n for n in columns if n not in open_]
    parts = []
    if settled:
        counted = long_text(df, settled).join(F.broadcast(found), ["column", "value"], "left_semi").groupBy("column", "value").agg(F.count("*").alias("n"))
        n_rows = df.sparkSession.createDataFrame([(n, rows[n]) for n in settled], "column string, n_rows bigint")
        parts.append(top_values(counted, k).join(F.broadcast(n_rows), "column"))
    if open_:
        counts = value_counts(df, open_).persist()
        parts.append(top_values(counts, k).join(F.broadcast(column_summary(counts).select("column", "n_rows")), "column"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("column", "value", "n", "rank", "n_rows")
