"""Temporal holdout, segment heuristics and model benchmark queries on the flow history."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.profiling import BOX_SQL, rounded
from queries.tables import FLOW_ROLES, FLOW_SQL, flow
from tidegauge.operators import models as M
from tidegauge.operators import temporal as T
from tidegauge.operators.bundle import best_beside
from tidegauge.operators.overview import learning_facts

FAMILIES = (
    T.family("Type"), T.family("Owner"), T.family("Size"), T.family("Type", "Size"), T.family("Owner", "Size"), T.family("Owner", "Type"),
)


def split(spark, sf_dir):
    return T.temporal_split(flow(spark, sf_dir), "value", "week")


def segments(spark, sf_dir, **options):
    found = split(spark, sf_dir)
    return found, T.build_segments(found, FAMILIES, **options)


def sizes(spark, sf_dir):
    return segments(spark, sf_dir)[1].sizes.drop("representative")


def medians(blind):
    def run(spark, sf_dir):
        return rounded(segments(spark, sf_dir, holdout_blind=blind)[1].medians, digits=6)

    return run


def family_metrics(spark, sf_dir):
    return rounded(T.heuristic_metrics(segments(spark, sf_dir)[1]), digits=6)


def heuristics(spark, sf_dir):
    found = T.heuristic_table(*segments(spark, sf_dir))
    return rounded(found.select("family", "model_name", "n", "mae", "rmse", "r2", "medae", "baseline_mae", "train_mae"), digits=6)


def tiers(spark, sf_dir):
    return T.tier_usage(T.backoff_rows(*segments(spark, sf_dir)))


def backoff_predictions(spark, sf_dir):
    rows = T.backoff_rows(*segments(spark, sf_dir))
    return rounded(T.prediction_table(rows, "row_id", "week"), digits=6)


def report(spark, sf_dir):
    found, segs = segments(spark, sf_dir)
    rows = T.backoff_rows(found, segs).withColumnRenamed("predicted", "heuristic").drop("tier")
    line = found.train.agg(F.regr_slope("y", "week").alias("slope"), F.regr_intercept("y", "week").alias("start")).first()
    rows = rows.withColumn("regression", F.lit(line["start"]) + F.lit(line["slope"]) * F.col("week"))
    return rounded(T.segment_report(found, segs, rows), digits=6)


def model_report(spark, sf_dir):
    """The same report with the best learner of the whole grid beside the best heuristic."""
    found, segs = segments(spark, sf_dir)
    return T.segment_report(found, segs, best_beside(benchmark(spark, sf_dir), segs))


def family_predictions(spark, sf_dir):
    found, segs = segments(spark, sf_dir)
    return rounded(T.prediction_table(T.family_rows(found, segs, FAMILIES[4]), "row_id", "week"), digits=6)


def diagnostics(spark, sf_dir):
    found = rounded(T.target_diagnostics(split(spark, sf_dir)), digits=6)
    return found.withColumn("min", F.round("min", 6)).withColumn("max", F.round("max", 6))


def benchmark(spark, sf_dir):
    """All learners with their full tree and round counts on all strategies."""
    return M.run_benchmark(split(spark, sf_dir), {**M.default_models(), "External Booster": None})


def invariants(spark, sf_dir):
    """What must hold of the whole grid, whatever the trees look like: sizes, the baseline's errors, the best learner's place."""
    found, tables = split(spark, sf_dir), benchmark(spark, sf_dir)
    rows = tables.rows
    learned = rows.filter("strategy <> 'baseline'")
    sides = found.rows.agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))
    base = rows.filter("strategy = 'baseline'").agg(*[F.round(F.max(m), 6).alias(f"baseline_{m}") for m in ("mae", "rmse", "medae")])
    runs = learned.agg(
        F.count_if("available").alias("runs"), F.count_distinct("model_name").alias("learners"), F.count_if(~F.col("available")).alias("unavailable"),
        F.count_distinct("strategy_label").alias("labels"), F.count_if(F.col("train_mae") < 0).alias("negative"), F.min("train_mae").alias("best"))
    best = rows.filter("strategy = 'baseline'").agg(F.max("train_mae").alias("floor")).crossJoin(runs).select((F.col("best") <= F.col("floor")).cast("int").alias("best_in_training_not_above_baseline"))
    one = sides.crossJoin(base).crossJoin(runs.drop("best")).crossJoin(best)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in one.columns])))


def benchmark_rows(spark, sf_dir):
    return M.by_strategy(benchmark(spark, sf_dir).rows)


def best_models(spark, sf_dir):
    return M.ranked_models(benchmark(spark, sf_dir).rows)


def effects(spark, sf_dir):
    return benchmark(spark, sf_dir).effects


def winner(spark, sf_dir):
    found, segs = segments(spark, sf_dir)
    rows = benchmark(spark, sf_dir).rows.filter(F.col("strategy") != "baseline")
    return M.compare_strategies(rows, T.heuristic_table(found, segs))


QUERIES = {
    "temporal_split_flow": lambda s, d: T.split_summary(split(s, d)),
    "segment_sizes_flow": sizes,
    "segment_medians_flow": medians(False),
    "segment_medians_train_only": medians(True),
    "heuristic_metrics_flow": family_metrics,
    "heuristic_table_flow": heuristics,
    "backoff_tier_usage": tiers,
    "backoff_predictions": backoff_predictions,
    "segment_report_flow": report,
    "family_predictions_flow": family_predictions,
    "target_diagnostics_flow": diagnostics,
    "training_warnings_flow": lambda s, d: T.training_warnings(split(s, d)).select("code", "severity", "column"),
    "learning_facts_flow": lambda s, d: rounded(learning_facts(flow(s, d), "value"), digits=6),
    "model_benchmark_flow": benchmark_rows,
    "model_ranking_flow": best_models,
    "model_effects_flow": effects,
    "strategy_comparison_flow": winner,
    "segment_report_models": model_report,
    "model_invariants_flow": invariants,
}

_COLUMNS = {f.key: " || ' | ' || ".join(f"coalesce({n}, '<MISSING>')" for n in f.columns) for f in FAMILIES}
_LABELS = " UNION ALL ".join(f"SELECT '{k}' AS family, row_id, {e} AS label, y, is_test FROM sp" for k, e in _COLUMNS.items())


def base_sql(rule="tr >= 100 AND te >= 30"):
    return f"""WITH {FLOW_SQL},
sp AS (SELECT *, value AS y, week = (SELECT max(week) FROM flow) AS is_test FROM flow WHERE value IS NOT NULL AND week IS NOT NULL),
lb AS ({_LABELS}),
sz AS (SELECT family, label, count(*) FILTER (NOT is_test) AS tr, count(*) FILTER (is_test) AS te FROM lb GROUP BY ALL),
bl AS (SELECT quantile_cont(y, 0.5) AS b FROM sp WHERE NOT is_test),
sg AS (SELECT lb.*, CASE WHEN {rule} THEN lb.label ELSE 'Other' END AS segment FROM lb JOIN sz USING (family, label)),
md AS (SELECT family, segment, quantile_cont(y, 0.5) AS median FROM sg WHERE NOT is_test GROUP BY ALL),
pr AS (SELECT sg.*, coalesce(md.median, b) AS predicted, b FROM sg LEFT JOIN md USING (family, segment), bl)"""


METRICS = """count(*) AS n, round(avg(abs(y - predicted)), 6) AS mae, round(sqrt(avg(pow(y - predicted, 2))), 6) AS rmse,
  round(1 - sum(pow(y - predicted, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(quantile_cont(abs(y - predicted), 0.5), 6) AS medae,
  round(avg(abs(y - b)), 6) AS baseline_mae"""

_ORDER = " ".join(f"WHEN '{f.key}' THEN {i}" for i, f in enumerate(FAMILIES))
_SIMPLE = ", ".join(f"'{f.key}'" for f in FAMILIES if f.simple)
_BACKOFF = f""",
fm AS (SELECT family, avg(abs(y - predicted)) AS mae, CASE family {_ORDER} END AS pos FROM pr WHERE NOT is_test GROUP BY family),
bs AS (SELECT family FROM fm WHERE family IN ({_SIMPLE}) ORDER BY mae, pos LIMIT 1),
bc AS (SELECT family FROM fm WHERE family NOT IN ({_SIMPLE}) ORDER BY mae, pos LIMIT 1),
bo AS (SELECT sp.row_id, sp.week, sp.y, sp.is_test, bl.b,
         CASE WHEN c.segment <> 'Other' THEN c.predicted WHEN s.segment <> 'Other' THEN s.predicted ELSE bl.b END AS predicted,
         CASE WHEN c.segment <> 'Other' THEN 'Best Combination' WHEN s.segment <> 'Other' THEN 'Best Simple Segment' ELSE 'Global Median' END AS tier
       FROM sp JOIN pr c ON c.row_id = sp.row_id AND c.family = (SELECT family FROM bc)
               JOIN pr s ON s.row_id = sp.row_id AND s.family = (SELECT family FROM bs), bl)"""
_ALL = f""",
al AS (SELECT family, 'Heuristic Median - ' || CASE family {" ".join(f"WHEN '{f.key}' THEN '{f.label}'" for f in FAMILIES)} END AS model_name, y, predicted, b, is_test FROM pr
  UNION ALL SELECT 'hierarchical_backoff', 'Hierarchical Backoff', y, predicted, b, is_test FROM bo
  UNION ALL SELECT 'global', 'Global Median', y, b, b, is_test FROM sp, bl)"""

SQL = {
    "temporal_split_flow": f"WITH {FLOW_SQL} SELECT week AS period, week = (SELECT max(week) FROM flow) AS is_test, count(*) AS n FROM flow WHERE value IS NOT NULL GROUP BY week",
    "segment_sizes_flow": base_sql() + " SELECT family, label, tr AS train_count, te AS test_count FROM sz",
    "segment_medians_flow": base_sql() + " SELECT family, segment, round(median, 6) AS median FROM md",
    "segment_medians_train_only": base_sql("tr >= 100") + " SELECT family, segment, round(median, 6) AS median FROM md",
    "heuristic_metrics_flow": base_sql() + f" SELECT family, is_test, {METRICS} FROM pr GROUP BY family, is_test",
    "heuristic_table_flow": base_sql() + _BACKOFF + _ALL + f""", te AS (SELECT family, model_name, {METRICS} FROM al WHERE is_test GROUP BY ALL),
      tr AS (SELECT family, round(avg(abs(y - predicted)), 6) AS train_mae FROM al WHERE NOT is_test GROUP BY family) SELECT te.*, train_mae FROM te JOIN tr USING (family)""",
    "backoff_tier_usage": base_sql() + _BACKOFF + """ SELECT t.tier, count(bo.row_id) AS n FROM (VALUES ('Best Combination'), ('Best Simple Segment'), ('Global Median')) t(tier)
      LEFT JOIN bo ON bo.tier = t.tier AND bo.is_test GROUP BY t.tier""",
    "backoff_predictions": base_sql() + _BACKOFF + " SELECT row_id, CAST(week AS VARCHAR) AS period, y AS actual, round(predicted, 6) AS predicted FROM bo WHERE is_test",
    "segment_report_flow": base_sql() + _BACKOFF + """, fit AS (SELECT regr_slope(y, week) AS slope, regr_intercept(y, week) AS start FROM sp WHERE NOT is_test), ct AS (SELECT family, segment, count(*) FILTER (NOT is_test) AS train_count, count(*) FILTER (is_test) AS test_count FROM sg GROUP BY ALL)
      SELECT sg.family, sg.segment, round(avg(sg.y), 6) AS actual_mean, round(avg(abs(sg.y - (SELECT start + slope * bo.week FROM fit))), 6) AS regression_mae,
        round(avg(abs(sg.y - bo.predicted)), 6) AS heuristic_mae, round(avg(abs(sg.y - bo.b)), 6) AS baseline_mae, round(quantile_cont(sg.y, 0.5), 6) AS actual_median,
        any_value(train_count) AS train_count, any_value(test_count) AS test_count
      FROM sg JOIN bo USING (row_id) JOIN ct USING (family, segment) WHERE sg.is_test GROUP BY sg.family, sg.segment""",
    "model_invariants_flow": base_sql() + """, e AS (SELECT y, abs(y - b) AS a FROM sp, bl WHERE is_test),
      m AS (SELECT round(avg(a), 6) AS mae, round(sqrt(avg(a * a)), 6) AS rmse, round(quantile_cont(a, 0.5), 6) AS medae FROM e)
      SELECT 'train_rows' AS name, CAST(count(*) FILTER (NOT is_test) AS DOUBLE) AS value FROM sp
      UNION ALL SELECT 'test_rows', count(*) FILTER (is_test) FROM sp
      UNION ALL SELECT 'baseline_mae', mae FROM m UNION ALL SELECT 'baseline_rmse', rmse FROM m UNION ALL SELECT 'baseline_medae', medae FROM m
      UNION ALL SELECT * FROM (VALUES ('runs', 12.0), ('learners', 4.0), ('unavailable', 1.0), ('labels', 5.0), ('negative', 0.0), ('best_in_training_not_above_baseline', 1.0))""",
    "family_predictions_flow": base_sql() + f" SELECT row_id, CAST((SELECT max(week) FROM flow) AS VARCHAR) AS period, y AS actual, round(predicted, 6) AS predicted FROM pr WHERE is_test AND family = '{FAMILIES[4].key}'",
    "target_diagnostics_flow": f"""WITH {FLOW_SQL}, tr AS (SELECT value AS y, ln(1 + greatest(value, 0)) AS l FROM flow WHERE value IS NOT NULL AND week < (SELECT max(week) FROM flow)),
      lq AS (SELECT quantile_cont(l, 0.25) AS a, quantile_cont(l, 0.75) AS z FROM tr),
      cp AS (SELECT y, l, CASE WHEN abs(z - a) > 1e-8 THEN least(greatest(l, a - 1.5 * (z - a)), z + 1.5 * (z - a)) ELSE l END AS k FROM tr, lq),
      b AS (SELECT 'raw' AS step, 'days' AS scale, y AS v FROM cp UNION ALL SELECT 'log1p', 'log', l FROM cp UNION ALL SELECT 'log1p_outlier_norm', 'log', k FROM cp
            UNION ALL SELECT 'log1p_outlier_norm_restored', 'days', exp(k) - 1 FROM cp), """
        + BOX_SQL.replace("round(std, 6) AS std, min,", "round(std, 6) AS std, round(min, 6) AS min,").replace("AS p75, max,", "AS p75, round(max, 6) AS max,").format(g="step, scale"),
    "training_warnings_flow": f"""WITH {FLOW_SQL}, tr AS (SELECT value AS y FROM flow WHERE value IS NOT NULL AND week < (SELECT max(week) FROM flow)),
      q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS z FROM tr)
      SELECT 'target_high_skew' AS code, 'info' AS severity, 'value' AS "column" FROM tr HAVING abs(skewness(y)) >= 1
      UNION ALL SELECT 'target_outlier_pressure', 'info', 'value' FROM tr, q HAVING avg(CASE WHEN y > z + 1.5 * (z - a) THEN 1.0 ELSE 0.0 END) > 0.05
      UNION ALL SELECT 'temporal_holdout', 'info', 'week'""",
    "learning_facts_flow": f"""WITH {FLOW_SQL}, q AS (SELECT avg(value) AS mean, quantile_cont(value, 0.5) AS median, skewness(value) AS skew,
        quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper_fence FROM flow)
      SELECT round(any_value(mean), 6) AS mean, round(any_value(median), 6) AS median, round(any_value(skew), 6) AS skew, round(any_value(upper_fence), 6) AS upper_fence,
        round(avg(CASE WHEN value > upper_fence THEN 1.0 ELSE 0.0 END), 6) AS tail_ratio FROM flow, q WHERE value IS NOT NULL""",
}
