"""Audit, profile, variability, imputation and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.tables import FLOW_ROLES, FLOW_SQL, flow, table
from tidegauge.operators import impute as I
from tidegauge.operators import profile as P
from tidegauge.operators import quality as Q
from tidegauge.operators import variability as V
from tidegauge.functions.columns import Roles, analytical_columns
from tidegauge.plans.counts import value_counts
from tidegauge.plans.ordered import average_rank, ordered_counts

LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORIES = ["l_returnflag", "l_linestatus"]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def line_labels(spark, sf_dir):
    """Label columns from two values to nearly as many as rows, the keys as text."""
    keys = [F.col(n).cast("string").alias(n) for n in ("l_suppkey", "l_partkey", "l_orderkey")]
    return lines(spark, sf_dir).select("l_linestatus", "l_returnflag", *keys)


LINE_LABELS = ["l_linestatus", "l_returnflag", "l_suppkey", "l_partkey", "l_orderkey"]


def rounded(df, *skip, digits=5):
    kinds = dict(df.dtypes)
    return df.select(*[
        F.round(n, digits).alias(n) if kinds[n] == "double" and n not in skip else F.col(n) for n in df.columns
    ])


def graded(spark, sf_dir):
    """Documents with their partly missing grades."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = table(spark, sf_dir, "labels").withColumn("score", F.col("quality") * 2.0 + F.col("toxic"))
    marks = marks.withColumn("verdict", F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good"))
    return docs.join(marks.select("doc_id", "score", "verdict"), "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), "lang", "source", "n_chars", "score", "verdict"
    )


GRADED_SQL = """
graded AS (
  SELECT d.doc_id AS row_id, d.lang, d.source, d.n_chars, l.quality * 2.0 + l.toxic AS score,
         CASE WHEN l.toxic = 1 THEN 'bad' WHEN l.quality = 1 THEN 'good' END AS verdict
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def long_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS col, CAST({n} AS VARCHAR) AS val FROM {source}" for n in columns
    )


def k0_sql(source, columns):
    return f"SELECT col, val, count(*) AS n FROM ({long_sql(source, columns)}) GROUP BY col, val"


def describe_sql(source, columns, where="n > 0"):
    body = " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({n}) AS n, avg({n}) AS mean, stddev_samp({n}) AS std, var_samp({n}) AS variance,
        min({n}) * 1.0 AS min, max({n}) * 1.0 AS max, skewness({n}) AS skewness, kurtosis({n}) AS kurtosis,
        quantile_cont({n}, 0.25) AS p25, quantile_cont({n}, 0.5) AS p50, quantile_cont({n}, 0.75) AS p75 FROM {source}"""
        for n in columns
    )
    return f"SELECT * FROM ({body}) WHERE {where}"


def round_sql(inner, doubles, others, digits=5):
    kept = ", ".join(f'"{o}"' for o in others)
    return f'SELECT {kept}, {", ".join(f"round({d}, {digits}) AS {d}" for d in doubles)} FROM ({inner})'


STATS = ["mean", "std", "variance", "min", "max", "skewness", "kurtosis", "p25", "p50", "p75"]

HISTOGRAM_SQL = """
WITH raw AS ({raw}),
s AS (SELECT "column", count(v) AS n, min(v) AS mn, max(v) AS mx, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM raw WHERE v IS NOT NULL GROUP BY "column"),
w AS (SELECT *, CASE WHEN 2 * (q3 - q1) / pow(n, 1.0 / 3) > 0
        THEN least(2 * (q3 - q1) / pow(n, 1.0 / 3), (mx - mn) / (log2(n) + 1)) ELSE (mx - mn) / (log2(n) + 1) END AS width FROM s),
l AS (SELECT "column", CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi,
        CASE WHEN width > 0 THEN CAST(ceil((mx - mn) / width) AS INT) ELSE 1 END AS nb FROM w),
e AS (SELECT "column", bin, CASE WHEN bin = nb THEN hi ELSE lo + bin * ((hi - lo) / nb) END AS "left",
        CASE WHEN bin + 1 = nb THEN hi ELSE lo + (bin + 1) * ((hi - lo) / nb) END AS "right", bin = nb - 1 AS last
      FROM (SELECT *, unnest(range(nb)) AS bin FROM l))
SELECT e."column", CAST(e.bin AS INT) AS bin, round(e."left", 6) AS "left", round(e."right", 6) AS "right", count(r.v) AS count
FROM e LEFT JOIN raw r ON r."column" = e."column" AND r.v >= e."left" AND (r.v < e."right" OR (e.last AND r.v <= e."right"))
GROUP BY ALL
"""


def line_histogram(spark, sf_dir):
    df = P.histogram(lines(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(df, digits=6)


def flow_histogram(spark, sf_dir):
    return rounded(P.histogram(flow(spark, sf_dir), ["value", "week"]), digits=6)


def value_rank(spark, sf_dir):
    """Average rank of every distinct price per flag, through the sliced order statistics."""
    ordered = ordered_counts(lines(spark, sf_dir), ["l_returnflag"], "l_quantity", small=False)
    return ordered.select("l_returnflag", "l_quantity", "n", "before", "total", average_rank().alias("avg_rank"))


def box_by_type(spark, sf_dir):
    return rounded(P.box_stats(flow(spark, sf_dir), ["Type"], "value"), digits=6)


def box_by_type_sliced(spark, sf_dir):
    return rounded(P.box_stats(flow(spark, sf_dir), ["Type"], "value", small=False), digits=6)


def scores(mode="freq_only", strategy="frequency"):
    def run(spark, sf_dir):
        df = V.variability_scores(flow(spark, sf_dir), mode, strategy)
        return rounded(df.drop("recommendation", "mean_near_zero", "numeric_like"), digits=6)

    return run


def ranking(spark, sf_dir):
    return rounded(V.variability_ranking(V.variability_scores(flow(spark, sf_dir)), "entropy"), digits=6)


def scores_warnings(spark, sf_dir):
    return V.variability_warnings(V.variability_scores(flow(spark, sf_dir))).select("code", "severity", "column")


def flow_quality(spark, sf_dir):
    return Q.quality_warnings(flow(spark, sf_dir), FLOW_ROLES).select("code", "severity", "column")


def part_quality(spark, sf_dir):
    frame = table(spark, sf_dir, "part").withColumn("week", F.lit(5)).withColumn("flat", F.lit("x")).withColumn(
        "nearly", F.when(F.col("p_partkey") == 0, "a").otherwise("b"))
    return Q.quality_warnings(frame).select("code", "severity", "column")


def normalised_warnings(spark, sf_dir):
    frame = flow(spark, sf_dir).withColumn("week", F.lit(5))
    made = Q.quality_warnings(frame, FLOW_ROLES)
    extra = Q.warning_rows(frame, [
        ("overlap_column_conflict", "info", "Type", "m", "s"), ("overlap_column_conflict", "info", "Size", "m", "s"),
        ("constant_column", "warning", "week", "m", "s"), ("high_cardinality", "warning", "value", "m", "s"),
        ("constant_column", "warning", "row_id", "m", "s"),
    ])
    both = Q.dedupe_warnings(made.unionByName(made).unionByName(extra))
    return Q.normalise_warnings(both, frame, FLOW_ROLES).select("code", "severity", "column")


def findings(spark, sf_dir):
    return Q.quality_findings(graded(spark, sf_dir)).select("kind", "severity", "column")


def rare(spark, sf_dir):
    return Q.rare_categories(flow(spark, sf_dir)).select("column", "value", "n", "n_rows", "rank")


def imputed(spark, sf_dir):
    return I.impute(graded(spark, sf_dir)).groupBy("verdict", "score").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def imputation(spark, sf_dir):
    return I.imputation_report(graded(spark, sf_dir)).drop("fill")


def mode_values(spark, sf_dir):
    return I.modes(lines(spark, sf_dir), ["l_linenumber", "l_returnflag", "l_quantity", "l_tax"]).select(
        "column", F.col("mode").try_cast("double").alias("number"),
        F.when(F.col("mode").try_cast("double").isNull(), F.col("mode")).alias("label"), "mode_count")


def outliers(spark, sf_dir):
    return rounded(I.outlier_columns(lines(spark, sf_dir), LINE_NUMBERS)[0], digits=6)


def outlier_rows(spark, sf_dir):
    return I.outlier_columns(flow(spark, sf_dir), ["value", "week"])[1]


OUTLIER_SQL = """
raw AS ({raw}),
q AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.5) AS med
      FROM raw GROUP BY col HAVING min(v) < max(v)),
m AS (SELECT q.*, (SELECT quantile_cont(abs(r.v - q.med), 0.5) FROM raw r WHERE r.col = q.col) AS mad FROM q),
f AS (SELECT id, r.col, CASE WHEN abs(q3 - q1) > 1e-8 THEN q1 - 1.5 * (q3 - q1) END AS lo,
        CASE WHEN abs(q3 - q1) > 1e-8 THEN q3 + 1.5 * (q3 - q1) END AS hi,
        CASE WHEN abs(mad) > 1e-8 THEN abs(0.6745 * (v - med) / mad) END AS z, v FROM raw r JOIN m USING (col)),
g AS (SELECT *, coalesce(v < lo OR v > hi, false) OR coalesce(z > 3.5, false) AS hit FROM f)
"""

BOX_SQL = """
q AS (SELECT {g}, count(v) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, min(v) AS min, max(v) AS max,
        coalesce(skewness(v), 0) AS skew, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75
      FROM b GROUP BY {g}),
x AS (SELECT *, p75 - p25 AS iqr, CASE WHEN abs(p75 - p25) > 1e-8 THEN p25 - 1.5 * (p75 - p25) END AS lower_bound,
        CASE WHEN abs(p75 - p25) > 1e-8 THEN p75 + 1.5 * (p75 - p25) END AS upper_bound FROM q),
o AS (SELECT {g}, count(*) FILTER (b.v < x.lower_bound OR b.v > x.upper_bound) AS outlier_count FROM b JOIN x USING ({g}) GROUP BY {g})
SELECT {g}, n, round(mean, 6) AS mean, round(std, 6) AS std, min, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, max,
  round(skew, 6) AS skew, round(iqr, 6) AS iqr, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
  outlier_count, round(outlier_count / n, 6) AS outlier_ratio
FROM x JOIN o USING ({g})
"""

LINE_ALL = [*LINE_NUMBERS, *LINE_CATEGORIES]
FLOW_COLS = ["Owner", "Size", "Type", "week", "value"]

QUERIES = {
    "value_counts_lineitem": lambda s, d: value_counts(lines(s, d), ["l_linenumber", *LINE_CATEGORIES]),
    "missingness_graded": lambda s, d: Q.missingness(graded(s, d)),
    "missing_warnings_graded": lambda s, d: Q.missing_warnings(graded(s, d)).select("code", "severity", "column"),
    "cardinality_customer": lambda s, d: Q.cardinality(table(s, d, "customer")),
    "unique_identifiers_customer": lambda s, d: Q.unique_identifiers(table(s, d, "customer")),
    "duplicate_rows_lineitem": lambda s, d: Q.duplicate_rows(lines(s, d).select("l_partkey", "l_linenumber", "l_quantity")),
    "global_metrics_graded": lambda s, d: Q.global_metrics(graded(s, d)),
    "source_overview_graded": lambda s, d: Q.source_overview(graded(s, d).drop("row_id", "n_chars")),
    "top_categories_lineitem": lambda s, d: P.top_categories(lines(s, d).select(*LINE_CATEGORIES)),
    "top_categories_sketched": lambda s, d: P.top_categories(line_labels(s, d), sketched=True),
    "top_categories_flow": lambda s, d: P.top_categories(flow(s, d)),
    "categorical_profile_flow": lambda s, d: P.categorical_profile(flow(s, d)),
    "describe_lineitem": lambda s, d: rounded(P.describe(lines(s, d), LINE_NUMBERS)),
    "describe_lineitem_sliced": lambda s, d: rounded(
        P.numeric_summary(lines(s, d), ["l_quantity", "l_extendedprice"], small=False)),
    "numeric_profile_lineitem": lambda s, d: rounded(P.numeric_profile(lines(s, d), LINE_NUMBERS)),
    "numeric_profile_customer": lambda s, d: rounded(P.numeric_profile(table(s, d, "customer"))),
    "histogram_lineitem": line_histogram,
    "histogram_flow": flow_histogram,
    "average_rank_lineitem": value_rank,
    "period_counts_flow": lambda s, d: P.period_counts(flow(s, d), "week"),
    "box_stats_by_type": box_by_type,
    "box_stats_by_type_sliced": box_by_type_sliced,
    "entropy_gini_flow": lambda s, d: rounded(V.disorder(value_counts(flow(s, d))), digits=6),
    "coefficient_of_variation_lineitem": lambda s, d: rounded(V.coefficient_of_variation(lines(s, d), LINE_NUMBERS), digits=6),
    "variability_scores_flow": scores(),
    "variability_ordinal_frequency": scores("ordinal_map", "frequency"),
    "variability_ordinal_alphabetical": scores("ordinal_map", "alphabetical"),
    "variability_ranking_flow": ranking,
    "variability_warnings_flow": scores_warnings,
    "quality_warnings_flow": flow_quality,
    "quality_warnings_part": part_quality,
    "warnings_normalised": normalised_warnings,
    "quality_findings_graded": findings,
    "rare_categories_flow": rare,
    "imputed_graded": imputed,
    "imputation_report_graded": imputation,
    "modes_lineitem": mode_values,
    "outlier_columns_lineitem": outliers,
    "outlier_rows_flow": outlier_rows,
}


def _scores_sql(custom):
    return f"""
WITH {FLOW_SQL}, k AS ({k0_sql('flow', FLOW_COLS)}),
f AS (SELECT * FROM k WHERE val IS NOT NULL),
t AS (SELECT col, sum(n) AS total, sum(CASE WHEN try_cast(val AS DOUBLE) IS NOT NULL THEN n ELSE 0 END) AS nums,
        sum(try_cast(val AS DOUBLE) * n) AS weighted FROM f GROUP BY col),
e AS (SELECT f.col, -sum((n / total) * log2(n / total)) AS entropy, 1 - sum((n / total) * (n / total)) AS gini FROM f JOIN t USING (col) GROUP BY f.col),
o AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS by_freq, row_number() OVER (PARTITION BY col ORDER BY val) AS by_text FROM f),
r AS (SELECT col, sum(by_freq * n) AS frequency, sum(by_text * n) AS alphabetical FROM o GROUP BY col),
cv AS (SELECT 'week' AS col, stddev_samp(week) / avg(week) AS cv FROM flow UNION ALL SELECT 'value', stddev_samp(value) / avg(value) FROM flow)
SELECT t.col AS "column", CASE WHEN cv.col IS NULL THEN 'categorical' ELSE 'numeric' END AS dtype_group,
  CASE WHEN cv.col IS NULL THEN round(entropy, 6) END AS entropy, CASE WHEN cv.col IS NULL THEN round(gini, 6) END AS gini_impurity,
  round(cv.cv, 6) AS coefficient_variation,
  round(CASE WHEN nums / total >= 0.9 THEN weighted / total ELSE {custom} END, 6) AS custom_index
FROM t JOIN e USING (col) JOIN r USING (col) LEFT JOIN cv USING (col)
"""


def _with_mode(sql, mode):
    return f"SELECT *, '{mode}' AS custom_mode FROM ({sql})"


_GRADED_COLS = ["lang", "source", "n_chars", "score", "verdict"]
_LONG_LINES = " UNION ALL ".join(f"SELECT rowid AS id, '{n}' AS col, CAST({n} AS DOUBLE) AS v FROM lined" for n in LINE_NUMBERS)

SQL = {
    "value_counts_lineitem": f"SELECT col AS \"column\", val AS value, n FROM ({k0_sql('lineitem', ['l_linenumber', *LINE_CATEGORIES])})",
    "missingness_graded": f"WITH {GRADED_SQL} " + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing, round((count(*) - count({n})) / greatest(count(*), 1) * 100.0, 4) AS missing_pct FROM graded"
        for n in ["row_id", *_GRADED_COLS]),
    "missing_warnings_graded": f"WITH {GRADED_SQL}, k AS ({k0_sql('graded', ['row_id', *_GRADED_COLS])}) "
        "SELECT 'missing_values_detected' AS code, 'warning' AS severity, col AS \"column\" FROM k WHERE val IS NULL",
    "cardinality_customer": " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(DISTINCT {n}) AS distinct_values FROM customer"
        for n in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "unique_identifiers_customer": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(DISTINCT {n}) AS distinct_values FROM customer HAVING count(DISTINCT {n}) = count(*)"
        for n in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]) + ")",
    "duplicate_rows_lineitem": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_linenumber, l_quantity FROM lineitem)) AS duplicate_rows FROM lineitem",
    "global_metrics_graded": f"""WITH {GRADED_SQL} SELECT count(*) AS n_rows, 5 AS n_columns,
      5 * count(*) - count(lang) - count(source) - count(n_chars) - count(score) - count(verdict) AS missing_total,
      round((5 * count(*) - count(lang) - count(source) - count(n_chars) - count(score) - count(verdict)) / (5 * count(*)) * 100.0, 4) AS missing_pct_total,
      3 AS categorical_columns, 2 AS numeric_columns FROM graded""",
    "source_overview_graded": f"""WITH {GRADED_SQL} SELECT count(*) AS n_rows, 4 AS n_columns,
      4 * count(*) - count(lang) - count(source) - count(score) - count(verdict) AS missing_cells,
      round((1 - (4 * count(*) - count(lang) - count(source) - count(score) - count(verdict)) / (4 * count(*))) * 100.0, 4) AS completeness_pct,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, score, verdict FROM graded)) AS duplicate_rows,
      1 AS numeric_variables, 3 AS categorical_variables FROM graded""",
    "top_categories_lineitem": f"""WITH k AS ({k0_sql('lineitem', LINE_CATEGORIES)}),
      r AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rank, val, n FROM k WHERE val IS NOT NULL)
      SELECT col AS "column", rank, val AS value, n AS count, round(n / (SELECT count(*) FROM lineitem) * 100.0, 4) AS pct FROM r WHERE rank <= 10""",
    "top_categories_sketched": f"""WITH k AS ({k0_sql('lineitem', LINE_LABELS)}),
      r AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rank, val, n FROM k WHERE val IS NOT NULL)
      SELECT col AS "column", rank, val AS value, n AS count, round(n / (SELECT count(*) FROM lineitem) * 100.0, 4) AS pct FROM r WHERE rank <= 10""",
    "top_categories_flow": f"""WITH {FLOW_SQL}, k AS ({k0_sql('flow', ['Owner', 'Size', 'Type'])}),
      r AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rank, val, n FROM k WHERE val IS NOT NULL)
      SELECT col AS "column", rank, val AS value, n AS count, round(n / (SELECT count(*) FROM flow) * 100.0, 4) AS pct FROM r WHERE rank <= 10""",
    "categorical_profile_flow": f"""WITH {FLOW_SQL}, k AS ({k0_sql('flow', ['Owner', 'Size', 'Type'])}),
      r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rank FROM k WHERE val IS NOT NULL)
      SELECT col AS "column", count(*) AS total_categories, sum(CASE WHEN rank > 10 THEN n ELSE 0 END) AS other_count,
        round(sum(CASE WHEN rank > 10 THEN n ELSE 0 END) / (SELECT count(*) FROM flow) * 100.0, 4) AS other_pct FROM r GROUP BY col""",
    "describe_lineitem": round_sql(describe_sql("lineitem", LINE_NUMBERS), ["mean", "std", "min", "p25", "p50", "p75", "max"], ["column", "n"]),
    "describe_lineitem_sliced": round_sql(describe_sql("lineitem", ["l_quantity", "l_extendedprice"]), STATS, ["column", "n"]),
    "numeric_profile_lineitem": round_sql(
        f"SELECT *, p75 - p25 AS iqr, std / mean AS coefficient_variation FROM ({describe_sql('lineitem', LINE_NUMBERS, 'min <> max')})",
        [*STATS, "iqr", "coefficient_variation"], ["column", "n"]),
    "numeric_profile_customer": round_sql(
        f"SELECT *, p75 - p25 AS iqr, std / mean AS coefficient_variation FROM ({describe_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'], 'min <> max')})",
        [*STATS, "iqr", "coefficient_variation"], ["column", "n"]),
    "histogram_lineitem": HISTOGRAM_SQL.format(raw=" UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", {n} AS v FROM lineitem" for n in ["l_quantity", "l_extendedprice", "l_discount"])),
    "histogram_flow": f"WITH {FLOW_SQL}, " + HISTOGRAM_SQL.format(raw=" UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", CAST({n} AS DOUBLE) AS v FROM flow" for n in ["value", "week"])).strip()[len("WITH "):],
    "average_rank_lineitem": """SELECT l_returnflag, l_quantity, count(*) AS n,
      sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) AS before,
      sum(count(*)) OVER (PARTITION BY l_returnflag) AS total,
      sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) + (count(*) + 1) / 2.0 AS avg_rank
      FROM lineitem GROUP BY l_returnflag, l_quantity""",
    "period_counts_flow": f"""WITH {FLOW_SQL} SELECT CAST(week AS VARCHAR) AS period, count(*) AS count,
      (SELECT count(DISTINCT week) > 1 FROM flow) AS available FROM flow WHERE week IS NOT NULL GROUP BY week""",
    "box_stats_by_type": f"WITH {FLOW_SQL}, b AS (SELECT Type, value AS v FROM flow), " + BOX_SQL.format(g="Type"),
    "entropy_gini_flow": f"""WITH {FLOW_SQL}, k AS ({k0_sql('flow', FLOW_COLS)}), f AS (SELECT *, n / sum(n) OVER (PARTITION BY col) AS p FROM k WHERE val IS NOT NULL)
      SELECT col AS "column", round(-sum(p * log2(p)), 6) AS entropy, round(1 - sum(p * p), 6) AS gini_impurity FROM f GROUP BY col""",
    "coefficient_of_variation_lineitem": " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", round(CASE WHEN abs(avg({n})) > 1e-8 THEN stddev_samp({n}) / avg({n}) END, 6) AS coefficient_variation, abs(avg({n})) <= 1e-8 AS mean_near_zero FROM lineitem"
        for n in LINE_NUMBERS),
    "variability_scores_flow": _with_mode(_scores_sql("1.0"), "freq_only"),
    "variability_ordinal_frequency": _with_mode(_scores_sql("frequency / total"), "ordinal_map"),
    "variability_ordinal_alphabetical": _with_mode(_scores_sql("alphabetical / total"), "ordinal_map"),
    "variability_ranking_flow": f"SELECT \"column\", entropy AS score FROM ({_scores_sql('1.0')}) WHERE entropy IS NOT NULL ORDER BY score DESC, \"column\" LIMIT 20",
    "variability_warnings_flow": f"""WITH {FLOW_SQL}, k AS ({k0_sql('flow', ['Owner', 'Size', 'Type'])})
      SELECT 'custom_non_informative' AS code, 'info' AS severity, col AS "column" FROM k WHERE val IS NOT NULL GROUP BY col
      HAVING sum(CASE WHEN try_cast(val AS DOUBLE) IS NOT NULL THEN n ELSE 0 END) / sum(n) < 0.9""",
    "quality_warnings_flow": f"""WITH {FLOW_SQL}, k AS ({k0_sql('flow', FLOW_COLS)}),
      p AS (SELECT col, count(val) AS d, coalesce(max(CASE WHEN val IS NOT NULL THEN n END), 0) AS top, sum(n) AS rows FROM k GROUP BY col)
      SELECT CASE WHEN col = 'week' THEN 'week_constant' ELSE 'constant_column' END AS code, 'warning' AS severity, col AS "column" FROM p WHERE d <= 1
      UNION ALL SELECT 'near_constant_column', 'warning', col FROM p WHERE d > 1 AND top / rows >= 0.98
      UNION ALL SELECT 'high_cardinality', 'warning', col FROM p WHERE d > 1 AND col IN ('Owner', 'Size', 'Type') AND (d > 50 OR d / rows > 0.30)""",
    "quality_warnings_part": f"""WITH src AS (SELECT *, 5 AS week, 'x' AS flat, CASE WHEN p_partkey = 0 THEN 'a' ELSE 'b' END AS nearly FROM part),
      k AS ({k0_sql('src', ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice', 'week', 'flat', 'nearly'])}),
      p AS (SELECT col, count(val) AS d, coalesce(max(CASE WHEN val IS NOT NULL THEN n END), 0) AS top, sum(n) AS rows FROM k GROUP BY col)
      SELECT CASE WHEN col = 'week' THEN 'week_constant' ELSE 'constant_column' END AS code, 'warning' AS severity, col AS "column" FROM p WHERE d <= 1
      UNION ALL SELECT 'near_constant_column', 'warning', col FROM p WHERE d > 1 AND top / rows >= 0.98
      UNION ALL SELECT 'high_cardinality', 'warning', col FROM p WHERE d > 1 AND col IN ('p_name', 'p_brand', 'p_type', 'flat', 'nearly') AND (d > 50 OR d / rows > 0.30)""",
    "warnings_normalised": f"""WITH {FLOW_SQL} SELECT 'week_constant' AS code, 'warning' AS severity, 'week' AS "column"
      UNION ALL SELECT 'overlap_column_conflict', 'info', NULL
      UNION ALL SELECT 'high_cardinality', 'warning', 'Owner' FROM flow HAVING count(DISTINCT Owner) > 50 OR count(DISTINCT Owner) / count(*) > 0.30""",
    "quality_findings_graded": f"""WITH {GRADED_SQL}, k AS ({k0_sql('graded', _GRADED_COLS)}), n AS (SELECT count(*) AS rows FROM graded),
      p AS (SELECT col, count(val) AS d, coalesce(max(CASE WHEN val IS NOT NULL THEN n END), 0) AS top, sum(n) AS rows FROM k GROUP BY col)
      SELECT 'exact_duplicates' AS kind, 'warning' AS severity, CAST(NULL AS VARCHAR) AS "column" FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM graded)) AS d FROM graded) WHERE d > 0
      UNION ALL SELECT 'missing_values', 'warning', col FROM k WHERE val IS NULL
      UNION ALL SELECT DISTINCT 'rare_categories', 'info', col FROM k, n WHERE val IS NOT NULL AND k.n / rows < 0.01 AND col IN ('lang', 'source', 'verdict')
      UNION ALL SELECT 'limited_variation', 'warning', col FROM p WHERE d <= 1 OR top / rows >= 0.98
      UNION ALL SELECT 'high_cardinality', 'warning', col FROM p WHERE d > 1 AND col IN ('lang', 'source', 'verdict') AND (d > 50 OR d / rows > 0.30)""",
    "rare_categories_flow": f"""WITH {FLOW_SQL}, k AS ({k0_sql('flow', ['Owner', 'Size', 'Type'])}), s AS (SELECT count(*) AS n_rows FROM flow),
      r AS (SELECT col AS "column", val AS value, n, n_rows, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS rank FROM k, s WHERE val IS NOT NULL AND n / n_rows < 0.01)
      SELECT * FROM r WHERE rank <= 5""",
    "imputed_graded": f"""WITH {GRADED_SQL},
      m AS (SELECT (SELECT verdict FROM graded WHERE verdict IS NOT NULL GROUP BY verdict ORDER BY count(*) DESC, verdict LIMIT 1) AS v, (SELECT quantile_cont(score, 0.5) FROM graded) AS s)
      SELECT coalesce(verdict, m.v) AS verdict, CAST(coalesce(score, m.s) AS DOUBLE) AS score, count(*) AS n, sum(n_chars) AS chars FROM graded, m GROUP BY 1, 2""",
    "imputation_report_graded": f"WITH {GRADED_SQL} SELECT *, CASE WHEN strategy = 'none' THEN 0 ELSE missing END AS imputed FROM (SELECT \"column\", missing, missing_pct, CASE WHEN missing = 0 OR \"column\" = 'row_id' THEN 'none' WHEN \"column\" IN ('score', 'n_chars') THEN 'median' ELSE 'mode' END AS strategy FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing, round((count(*) - count({n})) / count(*) * 100.0, 4) AS missing_pct FROM graded"
        for n in ["row_id", *_GRADED_COLS]) + "))",
    "modes_lineitem": "WITH " + ", ".join(
        f"m{i} AS (SELECT {n} AS v, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, v LIMIT 1)" for i, n in enumerate(["l_linenumber", "l_quantity", "l_tax", "l_returnflag"])) + " "
        + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", CAST(v AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS label, c AS mode_count FROM m{i}" for i, n in enumerate(["l_linenumber", "l_quantity", "l_tax"]))
        + " UNION ALL SELECT 'l_returnflag', NULL, v, c FROM m3",
    "outlier_columns_lineitem": f"WITH lined AS (SELECT row_number() OVER () AS rowid, * FROM lineitem), " + OUTLIER_SQL.format(raw=_LONG_LINES) + """
      SELECT col AS "column", count(*) FILTER (hit) AS flagged_count, round(count(*) FILTER (hit) / count(*) * 100.0, 4) AS flagged_ratio,
        round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound, round(max(z), 6) AS max_abs_robust_z FROM g GROUP BY col""",
    "outlier_rows_flow": f"WITH {FLOW_SQL}, " + OUTLIER_SQL.format(raw="SELECT row_id AS id, 'value' AS col, value AS v FROM flow UNION ALL SELECT row_id, 'week', week FROM flow") + """
      SELECT count(DISTINCT id) FILTER (hit) AS flagged_rows, round(count(DISTINCT id) FILTER (hit) / count(DISTINCT id) * 100.0, 4) AS flagged_ratio FROM g""",
}
SQL["box_stats_by_type_sliced"] = SQL["box_stats_by_type"]
