"""Temporal holdout, segment-median heuristics and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import OTHER_LABEL, Roles, as_number, c, near_zero, segment_label
from tidegauge.operators.profile import box_stats, numeric_summary
from tidegauge.operators.quality import as_warning, quality_warnings, warning_rows
from tidegauge.plans.ordered import quantiles
from tidegauge.plans.sizing import attach, materialised

# Rows that make a segment representative, report thresholds, strategy labels.
TRAIN_ROWS, HOLDOUT_ROWS = 100, 30
HIGH_SKEW, UPPER_TAIL_SHARE = 1.0, 0.05
BASELINE = "Global Median"
BACKOFF = "Hierarchical Backoff"
TIERS = ("Best Combination", "Best Simple Segment", BASELINE)
STRATEGY_LABELS = {
    "raw": "Raw target",
    "log1p": "Log1p target",
    "log1p_outlier_norm": "Log1p + outlier normalization",
    "winsor_iqr": "Winsor IQR",
    "baseline": "Baseline",
}
TIE = 1e-9


@dataclass(frozen=True)
class Family:
    """A segmentation: the columns whose joined values name the segment."""

    columns: tuple[str, ...]
    key: str
    label: str

    @property
    def simple(self) -> bool:
        return len(self.columns) == 1


def family(*columns: str) -> Family:
    return Family(columns, "_".join(n.lower() for n in columns), " x ".join(columns))


DEFAULT_FAMILIES = (
    family("Type"), family("Quality"), family("Owner"), family("Size"),
    family("Type", "Quality"), family("Owner", "Size"), family("Owner", "Type"),
)


@dataclass(frozen=True)
class Split:
    """All valid rows with the target ``y`` and the holdout flag."""

    rows: DataFrame
    holdout: int
    target: str
    period: str

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("is_test")


def valid_rows(df: DataFrame, target: str, period: str) -> DataFrame:
    """Rows with a numeric target and period."""
    typed = df.select(*[(as_number(df, n).alias(n) if n in (target, period) else c(n)) for n in df.columns])
    return typed.filter(c(target).isNotNull() & c(period).isNotNull())


def temporal_split(df: DataFrame, target: str, period: str) -> Split:
    """Earlier periods train, the last period is held out; at least two periods are needed."""
    for name in (target, period):
        if name not in df.columns:
            raise ValueError(f"missing_{'target' if name == target else 'week'}: column '{name}' is required")
    rows = valid_rows(df, target, period)
    whole = c(period).cast("bigint")
    last = rows.agg(F.max(whole).alias("last"), F.min(whole).alias("first")).first()
    if last["last"] is None:
        raise ValueError("temporal_ml_empty: no row has a numeric target and period")
    if last["last"] == last["first"]:
        raise ValueError("insufficient_temporal_history: at least two periods are required")
    holdout = int(last["last"])
    # A fractional period beyond the last whole one belongs to neither side.
    kept = rows.filter(c(period) <= holdout)
    split = Split(
        kept.withColumn("y", c(target)).withColumn("is_test", c(period) == holdout), holdout, target, period
    )
    if not split.train.take(1) or not split.test.take(1):
        raise ValueError("invalid_temporal_split: one side of the split is empty")
    return split


def split_summary(split: Split) -> DataFrame:
    """Rows per period and side."""
    return split.rows.groupBy(c(split.period).cast("bigint").alias("period"), "is_test").agg(F.count("*").alias("n"))


def baseline_median(split: Split) -> float:
    values = split.train.select("y")
    return quantiles(values, [], "y", {"m": 0.5}).first()["m"]


# --- metrics ------------------------------------------------------------------------------------


def regression_metrics(
    scored: DataFrame, by: Sequence[str], baseline: float, predicted: str = "predicted", weight: str | None = None
) -> DataFrame:
    """Mean, root-mean-square and median absolute error, R2 and the error of the baseline, per group."""
    keys = [c(k) for k in by]
    w = c(weight).cast("double") if weight else F.lit(1.0)
    error, centred = F.col("y") - c(predicted), F.col("y") - F.lit(float(baseline))
    sums = scored.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * F.abs(error)).alias("abs"), F.sum(w * error * error).alias("sse"),
        F.sum(w * centred).alias("s"), F.sum(w * centred * centred).alias("ss"), F.sum(w * F.abs(centred)).alias("base"),
    )
    spread = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    flat = spread <= 1e-12 * F.greatest(F.col("ss"), F.lit(1.0))
    r2 = F.when(F.col("n") <= 1, None).when(flat, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - F.try_divide(F.col("sse"), spread)
    )
    counted = [c(weight).cast("bigint").alias("w")] if weight else []
    medians = quantiles(scored.select(*keys, F.abs(error).alias("e"), *counted), by, "e", {"medae": 0.5}, weight="w" if weight else None)
    return sums.join(medians, list(by)).select(
        *keys, F.col("n").cast("bigint").alias("n"), (F.col("abs") / F.col("n")).alias("mae"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), r2.alias("r2"), "medae",
        (F.col("base") / F.col("n")).alias("baseline_mae"),
    )


# --- segments -----------------------------------------------------------------------------------


def _families(split: Split, families: Sequence[Family]) -> list[Family]:
    missing = {n for f in families for n in f.columns if n not in split.rows.columns}
    if missing:
        raise ValueError(f"Segment columns missing: {', '.join(sorted(missing))}")
    return list(families)


def labelled(rows: DataFrame, families: Sequence[Family], keep: Sequence[str]) -> DataFrame:
    """One row per input row and family, with the segment label."""
    structs = [F.struct(F.lit(f.key).alias("family"), segment_label(f.columns).alias("label")) for f in families]
    return rows.select(*[c(k) for k in keep], F.inline(F.array(*structs)))


@dataclass(frozen=True)
class Segments:
    """Everything the heuristics need, collapsed to ``(family, segment, is_test, y, w)``."""

    families: tuple[Family, ...]
    sizes: DataFrame
    cells: DataFrame
    medians: DataFrame
    baseline: float


def segment_sizes(cells: DataFrame, train_rows: int, holdout_rows: int, holdout_blind: bool) -> DataFrame:
    """Train and holdout rows per label; small ones are not representative.

    ``holdout_blind`` decides from training rows alone.
    """
    train, test = F.sum(F.when(~F.col("is_test"), F.col("w"))), F.sum(F.when(F.col("is_test"), F.col("w")))
    sized = cells.groupBy("family", "label").agg(
        F.coalesce(train, F.lit(0)).alias("train_count"), F.coalesce(test, F.lit(0)).alias("test_count")
    )
    enough = F.col("train_count") >= train_rows
    if not holdout_blind:
        enough = enough & (F.col("test_count") >= holdout_rows)
    return sized.withColumn("representative", enough)


def build_segments(
    split: Split, families: Sequence[Family] = DEFAULT_FAMILIES, train_rows: int = TRAIN_ROWS,
    holdout_rows: int = HOLDOUT_ROWS, holdout_blind: bool = False, baseline: float | None = None,
) -> Segments:
    """Fold small segments into one label and take training medians, all families in one pass."""
    families = _families(split, families)
    columns = list(dict.fromkeys(n for f in families for n in f.columns))
    joint = split.rows.groupBy(*[c(n) for n in columns], "is_test").agg(F.count("*").alias("w"))
    sizes = materialised(segment_sizes(labelled(joint, families, ["is_test", "w"]), train_rows, holdout_rows, holdout_blind))
    # Values are counted once small labels are folded, so that only segments that stay apart have cells of their own.
    folded = materialised(
        in_segments(labelled(split.rows, families, ["y", "is_test"]), sizes)
        .groupBy("family", "segment", "is_test", "y").agg(F.count("*").alias("w"))
    )
    medians = quantiles(folded.filter(~F.col("is_test")), ["family", "segment"], "y", {"median": 0.5}, weight="w").persist()
    if baseline is None:
        baseline = _baseline(folded, families) if families else baseline_median(split)
    return Segments(tuple(families), sizes, folded, medians, baseline)


def _baseline(cells: DataFrame, families: Sequence[Family]) -> float:
    """Training median, from the cells of the first family: each family has all rows."""
    own = cells.filter((F.col("family") == families[0].key) & ~F.col("is_test")).groupBy("y").agg(F.sum("w").alias("w"))
    return quantiles(own, [], "y", {"m": 0.5}, weight="w").first()["m"]


def in_segments(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of ``labelled`` with their ``segment``. Only representative labels are looked up; all others are folded."""
    apart = sizes.filter("representative").select("family", "label", F.col("label").alias("segment"), (F.col("train_count") + F.col("test_count")).alias("__rows"))
    return attach(rows, apart, ["family", "label"], "__rows").withColumn("segment", F.coalesce("segment", F.lit(OTHER_LABEL)))


def heuristic_cells(segments: Segments) -> DataFrame:
    """Predicted median per cell; a segment without training rows falls back to the baseline."""
    weighted = segments.cells.groupBy("family", "segment").agg(F.sum("w").alias("rows"))
    lookup = weighted.join(segments.medians, ["family", "segment"], "left")
    placed = attach(segments.cells, lookup, ["family", "segment"], "rows")
    return placed.withColumn("predicted", F.coalesce("median", F.lit(segments.baseline)))


def heuristic_metrics(segments: Segments) -> DataFrame:
    """Metrics of every family on both sides."""
    return regression_metrics(heuristic_cells(segments), ["family", "is_test"], segments.baseline, weight="w")


def best_families(metrics: DataFrame, families: Sequence[Family]) -> tuple[Family | None, Family | None]:
    """Best simple and best combined family by training error, earlier families first among equals."""
    mae = {r["family"]: r["mae"] for r in metrics.filter(~F.col("is_test")).select("family", "mae").collect()}
    simple = [f for f in families if f.simple]
    combined = [f for f in families if not f.simple]
    pick = lambda group: min(group, key=lambda f: mae[f.key], default=None)
    return pick(simple), pick(combined)


def _lookup(segments: Segments, chosen: Family | None, name: str) -> DataFrame | None:
    if chosen is None:
        return None
    own = segments.sizes.filter((F.col("family") == chosen.key) & F.col("representative"))
    own = own.select(F.col("label").alias("segment"), (F.col("train_count") + F.col("test_count")).alias("__rows"))
    medians = segments.medians.filter((F.col("family") == chosen.key) & (F.col("segment") != OTHER_LABEL))
    joined = own.join(medians.select("segment", "median"), "segment")
    return joined.select(F.col("segment").alias(f"{name}_label"), F.col("median").alias(f"{name}_median"), "__rows")


def backoff(rows: DataFrame, segments: Segments, simple: Family | None, combined: Family | None) -> DataFrame:
    """Best combination median, else best simple median, else the baseline, with the tier used."""
    columns = rows.columns
    for name, chosen in (("combined", combined), ("simple", simple)):
        lookup = _lookup(segments, chosen, name)
        if lookup is None:
            rows = rows.withColumn(f"{name}_median", F.lit(None).cast("double"))
        else:
            rows = attach(rows.withColumn(f"{name}_label", segment_label(chosen.columns)), lookup, [f"{name}_label"], "__rows")
    tier = (
        F.when(F.col("combined_median").isNotNull(), TIERS[0]).when(F.col("simple_median").isNotNull(), TIERS[1]).otherwise(TIERS[2])
    )
    value = F.coalesce("combined_median", "simple_median", F.lit(segments.baseline))
    return rows.select(*[c(n) for n in columns], value.alias("predicted"), tier.alias("tier"))


def backoff_rows(split: Split, segments: Segments, metrics: DataFrame | None = None) -> DataFrame:
    simple, combined = best_families(metrics if metrics is not None else heuristic_metrics(segments), segments.families)
    return backoff(split.rows, segments, simple, combined)


def tier_usage(predicted: DataFrame) -> DataFrame:
    """Holdout rows served by each tier; unused tiers count zero."""
    used = predicted.filter("is_test").groupBy("tier").agg(F.count("*").alias("n"))
    listed = predicted.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return listed.join(used, "tier", "left").na.fill(0)


def family_rows(split: Split, segments: Segments, chosen: Family) -> DataFrame:
    """Row-level predictions of one family."""
    rows = split.rows.withColumn("label", segment_label(chosen.columns))
    sizes = segments.sizes.filter((F.col("family") == chosen.key) & F.col("representative"))
    medians = segments.medians.filter(F.col("family") == chosen.key).select("segment", "median")
    named = sizes.select("label", (F.col("train_count") + F.col("test_count")).alias("__rows"))
    lookup = named.join(medians.withColumnRenamed("segment", "label"), "label", "left").select(
        "label", F.coalesce("median", F.lit(segments.baseline)).alias("median"), "__rows")
    # A label that isn't looked up is folded, and folded labels share one median.
    folded = medians.filter(F.col("segment") == OTHER_LABEL).first()
    rest = segments.baseline if folded is None or folded["median"] is None else folded["median"]
    placed = attach(rows, lookup, ["label"], "__rows")
    return placed.withColumn("predicted", F.coalesce("median", F.lit(rest))).drop("label", "median")


def heuristic_table(split: Split, segments: Segments) -> DataFrame:
    """Every heuristic with its train and holdout metrics, best holdout error first."""
    metrics = heuristic_metrics(segments).persist()
    names = split.rows.sparkSession.createDataFrame(
        [(f.key, f"Heuristic Median - {f.label}", f.label) for f in segments.families], "family string, model_name string, family_label string"
    )
    own = metrics.join(F.broadcast(names), "family")
    collapsed = materialised(backoff_rows(split, segments, metrics).groupBy("is_test", "y", "predicted").agg(F.count("*").alias("w")))
    layered = regression_metrics(collapsed, ["is_test"], segments.baseline, weight="w")
    flat = collapsed.groupBy("is_test", "y").agg(F.sum("w").alias("w")).withColumn("predicted", F.lit(segments.baseline))
    floor = regression_metrics(flat, ["is_test"], segments.baseline, weight="w")

    def named(df: DataFrame, key: str, name: str, label: str) -> DataFrame:
        return df.select("*", F.lit(key).alias("family"), F.lit(name).alias("model_name"), F.lit(label).alias("family_label"))

    rows = own.unionByName(named(layered, "hierarchical_backoff", BACKOFF, BACKOFF)).unionByName(named(floor, "global", BASELINE, "Global"))
    side = lambda test, prefix: rows.filter(F.col("is_test") == test).select(
        "family", "model_name", "family_label", *[F.col(m).alias(f"{prefix}{m}") for m in ("n", "mae", "rmse", "r2", "medae", "baseline_mae")]
    )
    joined = side(True, "").join(side(False, "train_").drop("model_name", "family_label"), "family", "left")
    return joined.orderBy("mae", "model_name")


def segment_report(
    split: Split, segments: Segments, scored: DataFrame, predictions: Sequence[str] = ("regression", "heuristic")
) -> DataFrame:
    """Errors per holdout segment of several prediction columns of ``scored`` (holdout rows of the split)."""
    rows = labelled(scored.filter("is_test"), segments.families, ["y", *predictions])
    errors = in_segments(rows, segments.sizes).groupBy("family", "segment").agg(
        F.avg("y").alias("actual_mean"),
        *[F.avg(F.abs(F.col("y") - c(p))).alias(f"{p}_mae") for p in predictions],
        F.avg(F.abs(F.col("y") - F.lit(segments.baseline))).alias("baseline_mae"),
    )
    held = segments.cells.filter("is_test")
    medians = quantiles(held, ["family", "segment"], "y", {"actual_median": 0.5}, weight="w")
    counts = segments.cells.groupBy("family", "segment").agg(
        F.coalesce(F.sum(F.when(~F.col("is_test"), F.col("w"))), F.lit(0)).alias("train_count"),
        F.coalesce(F.sum(F.when(F.col("is_test"), F.col("w"))), F.lit(0)).alias("test_count"),
    )
    joined = errors.join(medians, ["family", "segment"]).join(counts, ["family", "segment"])
    return joined.orderBy("family", (F.col("segment") == OTHER_LABEL).asc(), F.desc("test_count"), "segment")


# --- target scales ------------------------------------------------------------------------------


def logged(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


@dataclass(frozen=True)
class Bounds:
    """Training fences of the raw and the logged target; absent where the quartiles coincide."""

    log_low: float | None
    log_high: float | None
    winsor_low: float
    winsor_high: float


def target_bounds(train: DataFrame) -> Bounds:
    both = train.select(F.col("y").alias("raw"), logged(F.col("y")).alias("log"))
    q = {
        name: quantiles(both.select(F.col(name).alias("v")), [], "v", {"a": 0.25, "b": 0.75}).first() for name in ("raw", "log")
    }
    span = q["log"]["b"] - q["log"]["a"]
    usable = abs(span) > 1e-8
    raw_span = q["raw"]["b"] - q["raw"]["a"]
    return Bounds(
        q["log"]["a"] - 1.5 * span if usable else None, q["log"]["b"] + 1.5 * span if usable else None,
        q["raw"]["a"] - 1.5 * raw_span, q["raw"]["b"] + 1.5 * raw_span,
    )


def clipped(value: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None:
        return value
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def transformed(strategy: str, bounds: Bounds, value: Column | None = None) -> Column:
    """Training target of a strategy. The winsor rule clips even when its fences coincide."""
    y = F.col("y") if value is None else value
    targets = {
        "raw": y,
        "winsor_iqr": clipped(y, bounds.winsor_low, bounds.winsor_high),
        "log1p": logged(y),
        "log1p_outlier_norm": clipped(logged(y), bounds.log_low, bounds.log_high),
    }
    if strategy not in targets:
        raise ValueError(f"No target strategy '{strategy}'; there are {', '.join(targets)}")
    return targets[strategy]


def restored(strategy: str, predicted: Column) -> Column:
    """Prediction on the original scale, never negative."""
    value = F.expm1(predicted) if strategy.startswith("log1p") else predicted
    return F.greatest(value, F.lit(0.0))


def target_diagnostics(split: Split, bounds: Bounds | None = None) -> DataFrame:
    """Box statistics of the training target on the raw, logged, normalised and restored scales."""
    bounds = bounds or target_bounds(split.train)
    y = F.col("y")
    capped = clipped(logged(y), bounds.log_low, bounds.log_high)
    steps = [
        ("raw", "days", y), ("log1p", "log", logged(y)), ("log1p_outlier_norm", "log", capped),
        ("log1p_outlier_norm_restored", "days", F.expm1(capped)),
    ]
    structs = [F.struct(F.lit(k).alias("step"), F.lit(s).alias("scale"), v.alias("v")) for k, s, v in steps]
    return box_stats(split.train.select(F.inline(F.array(*structs))), ["step", "scale"], "v")


def training_warnings(split: Split) -> DataFrame:
    """High skewness and upper-tail pressure of the training target, and the holdout notice."""
    stats = numeric_summary(split.train.select("y"), ["y"]).persist()
    skew = F.coalesce("skewness", F.lit(0.0))
    column = F.lit(split.target)
    skewed = stats.filter(F.abs(skew) >= HIGH_SKEW).select(
        *as_warning("target_high_skew", "info", column, F.format_string("The training target is skewed (%.2f).", skew),
                    "Compare the logged and capped target strategies."))
    spread = F.col("p75") - F.col("p25")
    fence = stats.filter(~near_zero(spread)).select((F.col("p75") + 1.5 * spread).alias("upper"), F.lit(1).alias("one"))
    tail = split.train.select("y", F.lit(1).alias("one")).join(F.broadcast(fence), "one").agg(
        F.avg((F.col("y") > F.col("upper")).cast("double")).alias("ratio"))
    pressed = tail.filter(F.col("ratio") > UPPER_TAIL_SHARE).select(
        *as_warning("target_outlier_pressure", "info", column,
                    F.format_string("%.2f%% of the training target lies above the upper fence.", F.col("ratio") * 100.0),
                    "Cap or log the target rather than dropping rows."))
    notice = warning_rows(split.rows, [("temporal_holdout", "info", split.period, f"Period {split.holdout} is held out.", "Keep the last period untouched.")])
    return skewed.unionByName(pressed).unionByName(notice)


def split_problems(df: DataFrame, target: str, period: str) -> DataFrame:
    """The reason a temporal evaluation is impossible, or no row."""
    try:
        temporal_split(df, target, period)
    except ValueError as error:
        code, message = str(error).split(": ", 1)
        return warning_rows(df, [(code, "warning", None, message, "Provide several periods with numeric targets.")])
    return warning_rows(df, [])


def data_warnings(split: Split, roles: Roles) -> DataFrame:
    return quality_warnings(split.rows.drop("y", "is_test"), roles)


def prediction_table(scored: DataFrame, key: str, period: str, predicted: str = "predicted") -> DataFrame:
    """Holdout rows with actual and predicted values under their key."""
    return scored.filter("is_test").select(
        c(key).alias("row_id"), c(period).cast("bigint").cast("string").alias("period"),
        F.col("y").alias("actual"), c(predicted).alias("predicted"),
    )
