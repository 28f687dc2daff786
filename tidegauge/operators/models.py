"""Model benchmark over target strategies: tree learners fitted beside each other on one cached training table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tidegauge.functions.columns import analytical_columns, as_text, c, is_numeric, present
from tidegauge.operators.cell_trees import Cells, CellTrees, collapse
from tidegauge.operators.impute import modes
from tidegauge.operators.quality import warning_rows
from tidegauge.operators.spread_trees import SpreadCells, fit_spread, spread_cells
from tidegauge.operators.temporal import (
    BASELINE,
    STRATEGY_LABELS,
    TIE,
    Bounds,
    Split,
    baseline_median,
    regression_metrics,
    restored,
    target_bounds,
    transformed,
)
from tidegauge.plans.counts import long_numbers
from tidegauge.plans.ordered import quantiles
from tidegauge.plans.sizing import is_small, materialised

# Learner settings, strategies in order, number of reported effects.
DEPTH, TREES, SEED = 5, 100, 42
ROUNDS, STEP, SUBSAMPLE = 150, 0.08, 0.9
STRATEGIES = ("raw", "log1p", "log1p_outlier_norm", "winsor_iqr")
EFFECTS_SHOWN = 12
HASHED_WIDTH = 4_096
#: Fits that run at the same time. Trees are fitted in many short jobs, which wait more than they compute.
PARALLELISM = 8

Factory = Callable[[], object]


def default_models(trees: int = TREES, rounds: int = ROUNDS) -> dict[str, Factory | None]:
    """Registry of learners: any Spark ML regressor of ``features`` and ``label`` to ``out`` fits too. A name without a factory is reported as unavailable."""
    return {
        "Decision Tree": lambda: CellTrees("tree", DEPTH, SEED),
        "Random Forest": lambda: CellTrees("forest", DEPTH, SEED, trees),
        "Gradient Boosting": lambda: CellTrees("boosting", DEPTH, SEED, rounds, STEP, SUBSAMPLE),
    }


@dataclass(frozen=True)
class Features:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    warnings: DataFrame
    hashed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Benchmark:
    rows: DataFrame
    scored: DataFrame
    runs: tuple[tuple[str, str, str], ...]
    effects: DataFrame
    features: Features
    warnings: DataFrame
    baseline: float
    models: Mapping[str, object] = field(default_factory=dict)

    def release(self) -> None:
        """Drop the cached scored rows."""
        self.scored.unpersist()


def eligible_features(split: Split, hashed: Sequence[str] = ()) -> Features:
    """Features that vary in training, numbers first. Label columns get a slot per level unless named in ``hashed``."""
    train = split.train
    candidates = [n for n in analytical_columns(split.rows) if n not in (split.target, "y", "is_test")]
    row = train.agg(*[(F.min(present(train, n)) != F.max(present(train, n))).alias(f"v{i}") for i, n in enumerate(candidates)]).first()
    varying = [n for i, n in enumerate(candidates) if row[f"v{i}"]]
    notes = [
        ("feature_excluded_constant", "info", n, f"{n} does not vary in training and was left out.", "Use features that vary.")
        for n in candidates if n not in varying
    ]
    if not varying:
        notes.append(("no_temporal_features", "warning", None, "No feature varies in training.", "Add features."))
    numeric = tuple(n for n in varying if is_numeric(train, n))
    labels = tuple(n for n in varying if n not in numeric)
    return Features(numeric, labels, warning_rows(split.rows, notes), tuple(n for n in labels if n in hashed))


def _filled(split: Split, features: Features) -> DataFrame:
    """Training medians and modes fill the gaps on both sides; columns without a gap need none."""
    train = split.train
    medians, common = {}, {}
    every = [*features.numeric, *features.categorical]
    gaps = split.rows.agg(F.lit(0).alias("z"), *[F.count_if(present(train, n).isNull()).alias(f"g{i}") for i, n in enumerate(every)]).first()
    gappy = [n for i, n in enumerate(every) if gaps[f"g{i}"]]
    numeric, labels = [n for n in gappy if n in features.numeric], [n for n in gappy if n in features.categorical]
    if numeric:
        found = quantiles(long_numbers(train, numeric), ["column"], "value", {"m": 0.5}, small=is_small(train))
        medians = {r["column"]: r["m"] for r in found.collect()}
    if labels:
        common = {r["column"]: r["mode"] for r in modes(train, labels).collect()}
    rows = split.rows
    numbers = [F.coalesce(present(rows, n).cast("double"), F.lit(float(medians.get(n) or 0.0))).alias(f"num_{i}") for i, n in enumerate(features.numeric)]
    labels = [F.coalesce(as_text(rows, n), F.lit(common.get(n, ""))).alias(f"cat_{i}") for i, n in enumerate(features.categorical)]
    return rows.select("*", *numbers, *labels)


def preprocessing(features: Features) -> Pipeline:
    """One-hot labels (unseen ones become all zeros), hashing for the columns asked for, one assembled vector."""
    stages, parts = [], [f"num_{i}" for i in range(len(features.numeric))]
    narrow = [i for i, n in enumerate(features.categorical) if n not in features.hashed]
    wide = [i for i, n in enumerate(features.categorical) if n in features.hashed]
    if narrow:
        indexed = [f"idx_{i}" for i in narrow]
        encoded = [f"hot_{i}" for i in narrow]
        stages.append(StringIndexer(inputCols=[f"cat_{i}" for i in narrow], outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True, handleInvalid="keep"))
        parts += encoded
    if wide:
        stages.append(FeatureHasher(inputCols=[f"cat_{i}" for i in wide], outputCol="hashed", numFeatures=HASHED_WIDTH))
        parts.append("hashed")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def _feature_names(assembled: DataFrame, features: Features) -> list[str]:
    """Readable name of every vector slot from the column attributes."""
    attributes = assembled.schema["features"].metadata.get("ml_attr", {})
    names: dict[int, str] = {}
    for group in attributes.get("attrs", {}).values():
        for attribute in group:
            names[attribute["idx"]] = attribute.get("name", f"slot_{attribute['idx']}")
    pretty = []
    for slot in range(attributes.get("num_attrs", len(names))):
        name = names.get(slot, f"slot_{slot}")
        kind, _, rest = name.partition("_")
        position, _, level = rest.partition("_")
        if kind == "num" and position.isdigit():
            name = features.numeric[int(position)]
        elif kind == "hot" and position.isdigit():
            name = f"{features.categorical[int(position)]}={level}"
        pretty.append(name)
    return pretty


def _top_effects(model: object, names: Sequence[str], features: Features) -> list[tuple[str, float]]:
    """Largest importances of a fitted model, under the names of columns and levels."""
    if hasattr(model, "effects"):
        pairs = []
        for column, level, value in model.effects():
            kind, position = column.split("_")
            name = (features.numeric if kind == "num" else features.categorical)[int(position)]
            pairs.append((name if level is None else f"{name}={level}", value))
    else:
        importances = getattr(model, "featureImportances", None)
        pairs = [] if importances is None else [(names[i], float(v)) for i, v in enumerate(importances.toArray())]
    return sorted(pairs, key=lambda p: (-abs(p[1]), p[0]))[:EFFECTS_SHOWN]


def _fit_together(jobs: Sequence[tuple[str, str, Factory]], cells: SpreadCells) -> dict[int, object]:
    """Models, or the error, of the jobs whose learner works on cells, by position. Equal learners fit all their targets in one job."""
    groups: dict[CellTrees, list[int]] = {}
    for at, (_, _, factory) in enumerate(jobs):
        learner = _learner(factory)
        if isinstance(learner, CellTrees):
            groups.setdefault(learner, []).append(at)
    found: dict[int, object] = {}
    for learner, places in groups.items():
        try:
            found |= zip(places, fit_spread(cells, learner, [f"target_{jobs[at][1]}" for at in places]))
        except Exception as error:
            found |= dict.fromkeys(places, error)
    return found


def _learner(factory: Factory) -> object | None:
    """What the factory makes; its failure is reported by the fit."""
    try:
        return factory()
    except Exception:
        return None


def fit_all(
    train: DataFrame, jobs: Sequence[tuple[str, str, Factory]], parallelism: int = PARALLELISM,
    cells: Cells | None = None, spread: SpreadCells | None = None,
) -> list[object]:
    """A fitted model, or the error, for each (learner, strategy, factory). Learners on cells share ``cells`` or, one after the other, ``spread``.

    Fits run in a bounded pool of threads. Each has a job group of its own and a pool of that
    name for sessions with the fair scheduler; the group is cancelled when its fit fails, so that no
    job of a failed fit goes on.
    """
    sc = train.sparkSession.sparkContext

    def one(job: tuple[str, str, Factory]) -> object:
        name, strategy, factory = job
        group = f"fit-{uuid.uuid4().hex}"
        sc.setJobGroup(group, f"{name} on {STRATEGY_LABELS[strategy]}", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", group)
        try:
            learner, target = factory(), f"target_{strategy}"
            if isinstance(learner, CellTrees) and cells is not None:
                return learner.fit(train, cells, target)
            learner = learner.distributed() if isinstance(learner, CellTrees) else learner
            return learner.fit(train.withColumn("label", c(target)))
        except Exception as error:
            sc.cancelJobGroup(group)
            return error
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    found = _fit_together(jobs, spread) if spread is not None else {}
    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs) or 1))) as pool:
        # Wrapped once a job, so that each thread has local properties of its own.
        waiting = {at: pool.submit(inheritable_thread_target(train.sparkSession)(one), job) for at, job in enumerate(jobs) if at not in found}
        return [found[at] if at in found else waiting[at].result() for at in range(len(jobs))]


def run_benchmark(
    split: Split,
    models: Mapping[str, Factory | None] | None = None,
    strategies: Sequence[str] = STRATEGIES,
    bounds: Bounds | None = None,
    hashed: Sequence[str] = (),
    parallelism: int = PARALLELISM,
) -> Benchmark:
    """Fit every learner on every target strategy beside each other, then score all runs in one pass.

    The split's rows and the prepared rows are cached once and released at the end; ``scored`` stays cached until
    ``release``. A failing fit becomes a row without metrics.
    """
    spark = split.rows.sparkSession
    models = default_models() if models is None else models
    split = replace(split, rows=split.rows.persist())
    bounds = bounds or target_bounds(split.train)
    baseline = baseline_median(split)
    features = eligible_features(split, hashed)
    if not features.numeric and not features.categorical:
        raise ValueError("no_temporal_features: no feature varies in training")
    filled = _filled(split, features)
    filled = materialised(filled.select("*", *[transformed(s, bounds).alias(f"target_{s}") for s in strategies]))
    targets = [f"target_{s}" for s in strategies]
    jobs = [(name, strategy, factory) for name, factory in models.items() if factory is not None for strategy in strategies]
    runs, fitted, effects, failures, notes, done = [], {}, [], [], [], set()
    train = filled.filter(~F.col("is_test"))
    cells = collapse(train, targets)
    spread = spread_cells(train, targets) if cells is None else None
    prepared, names = filled, []
    if (cells is None and spread is None) or not all(isinstance(_learner(factory), CellTrees) for _, _, factory in jobs):
        # The vector of one-hot labels is for Spark ML's learners alone.
        prepared = materialised(preprocessing(features).fit(train).transform(filled).select(*filled.columns, "features"))
        train, names = prepared.filter(~F.col("is_test")), _feature_names(prepared, features)
    for (name, strategy, _), model in zip(jobs, fit_all(train, jobs, parallelism, cells, spread)):
        if isinstance(model, Exception):
            notes.append(("model_training_failed", "warning", None, f"{name} with {STRATEGY_LABELS[strategy]} failed.", (str(model) or repr(model))[:500]))
            continue
        done.add(name)
        column = f"run_{len(runs)}"
        runs.append((name, strategy, column))
        fitted[column] = model
        effects += [(name, strategy, f, v) for f, v in _top_effects(model, names, features)]
    for name, factory in models.items():
        if factory is None:
            failures.append((name, "unavailable", "Not available", None, f"{name} has no learner in this session"))
            notes.append((f"{name.lower().replace(' ', '_')}_unavailable", "info", None, f"{name} is not available.", "Register a factory."))
        elif name not in done:
            failures.append((name, "failed", "No result", None, "no strategy finished training"))
    scored = prepared
    for name, strategy, column in runs:
        scored = fitted[column].transform(scored).withColumn(column, restored(strategy, F.col("out"))).drop("out")
    scored = materialised(scored.select(*split.rows.columns, *[column for _, _, column in runs]))
    for cached in (prepared, filled, split.rows):
        cached.unpersist()
    for collapsed in (cells, spread):
        if collapsed:
            collapsed.release()
    return Benchmark(
        _benchmark_rows(scored, runs, failures, baseline),
        scored, tuple(runs),
        spark.createDataFrame(effects, "model_name string, strategy string, feature string, importance double"),
        features, features.warnings.unionByName(warning_rows(split.rows, notes)), baseline, fitted,
    )


def _benchmark_rows(scored: DataFrame, runs, failures, baseline: float) -> DataFrame:
    """Metrics of every run, the baseline row, and rows for learners without a result."""
    spark = scored.sparkSession
    every = [(BASELINE, "baseline", None), *runs]
    structs = [
        F.struct(
            F.lit(name).alias("model_name"), F.lit(strategy).alias("strategy"),
            (F.col(column) if column else F.lit(float(baseline))).alias("predicted"),
        )
        for name, strategy, column in every
    ]
    metrics = regression_metrics(scored.select("y", "is_test", F.inline(F.array(*structs))), ["model_name", "strategy", "is_test"], baseline)
    metrics = materialised(metrics)
    test = metrics.filter("is_test").drop("is_test")
    train = metrics.filter(~F.col("is_test")).select("model_name", "strategy", *[F.col(m).alias(f"train_{m}") for m in ("mae", "rmse", "r2", "medae")])
    labels = spark.createDataFrame(list(STRATEGY_LABELS.items()), "strategy string, strategy_label string")
    rows = test.join(train, ["model_name", "strategy"]).join(F.broadcast(labels), "strategy", "left").withColumn("available", F.lit(True)).withColumn(
        "note", F.lit(None).cast("string"))
    if failures:
        missing = spark.createDataFrame(failures, "model_name string, strategy string, strategy_label string, mae double, note string")
        rows = rows.unionByName(missing.withColumn("available", F.lit(False)), allowMissingColumns=True)
    return rows


def best_run(benchmark: Benchmark) -> tuple[str, str, str] | None:
    """Run with the smallest holdout error."""
    top = ranked_models(benchmark.rows.filter(F.col("strategy") != "baseline")).filter("available").first()
    if top is None:
        return None
    return next(r for r in benchmark.runs if (r[0], r[1]) == (top["model_name"], top["strategy"]))


def ranked_models(rows: DataFrame) -> DataFrame:
    """Best strategy of each learner: available first, then error, then name."""
    best = rows.groupBy("model_name").agg(F.min_by(F.struct(*[c(n) for n in rows.columns if n != "model_name"]), F.struct(
        F.coalesce("mae", F.lit(float("inf"))), "strategy")).alias("r"))
    return best.select("model_name", "r.*").orderBy(F.desc("available"), F.asc_nulls_last("mae"), "model_name")


def by_strategy(rows: DataFrame) -> DataFrame:
    """Benchmark rows grouped by strategy in fixed order, then by error."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("baseline", *STRATEGIES)]), F.col("strategy"))
    return rows.orderBy(F.when(order == 0, 99).otherwise(order), F.asc_nulls_last("mae"), "model_name")


def compare_strategies(best_model: DataFrame, best_heuristic: DataFrame) -> DataFrame:
    """Best learner against best heuristic; errors within a hair count as a tie."""
    def one(df: DataFrame, prefix: str) -> DataFrame:
        top = df.orderBy("mae", "model_name").limit(1)
        return top.select(F.col("model_name").alias(f"{prefix}_model"), F.col("mae").alias(f"{prefix}_mae"), F.lit(1).alias("one"))

    gap = F.col("heuristic_mae") - F.col("regression_mae")
    winner = F.when(gap > TIE, "regression").when(gap < -TIE, "heuristic").otherwise("tie")
    joined = one(best_model.filter("available"), "regression").join(one(best_heuristic, "heuristic"), "one").drop("one")
    return joined.withColumn("mae_gap", gap).withColumn("winner", winner)
