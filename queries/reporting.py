"""Stored tables, pivot metadata, a source's section, the cluster view, and warnings on tables that raise them."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import clustering, profiling
from queries.profiling import GRADED_SQL, graded, k0_sql
from queries.tables import FLOW_ROLES, FLOW_SQL, flow, table
from tidegauge.functions.columns import Roles
from tidegauge.operators import bundle as B
from tidegauge.operators import cluster as K
from tidegauge.operators import impute as I
from tidegauge.operators import inference as N
from tidegauge.operators.ingest import load_source
from tidegauge.operators.pivot import pivot_metadata
from tidegauge.plans.sizing import shared_path
from tidegauge.sources import store
from tidegauge.sources.delimited import read_saved_text

PART_ROLES = Roles(class_code="p_size", target="p_retailprice", categorical=("p_type",))


def metadata(spark, sf_dir):
    return pivot_metadata(flow(spark, sf_dir), "out", FLOW_ROLES)


def section(spark, sf_dir):
    """Frequencies of the section of one source, named by their part."""
    df = flow(spark, sf_dir)
    found = B.source_section(df, df, "out", FLOW_ROLES)
    parts = [
        found.periods.select(F.lit("period").alias("part"), F.col("period").alias("name"), F.col("count").alias("n")),
        found.top_values.select(F.lit("top"), F.concat("column", F.lit("="), "value"), "count"),
        found.categorical.select(F.lit("categories"), "column", "total_categories"),
        found.identifiers.select(F.lit("identifier"), "column", "distinct_values"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def view(spark, sf_dir):
    """Weights of the projected points beside the overlap of the projection and its warning."""
    rows = flow(spark, sf_dir).select("row_id", "Type", "week")
    assigned = K.density_clusters(rows, clustering.SIDE, clustering.MIN_SAMPLES, clustering.MIN_SIZE, ["Type", "week"])
    found = K.cluster_view(assigned, ["Type", "week"], bucketed=False)
    weights = found.points.groupBy("display_weight").agg(F.count("*").alias("n"))
    raised = found.warnings.agg(F.max("code").alias("code"), F.max("message").alias("message"))
    return weights.join(F.broadcast(found.overlap.join(raised)))


def stored_clusters(spark, sf_dir):
    path, assigned = shared_path(spark, "clusters"), clustering.clustered(spark, sf_dir)
    store.save_clusters(assigned, K.cluster_summary(assigned, ["Type"], ["week", "value"]), path)
    loaded, _ = store.load_clusters(spark, path)
    return loaded.groupBy("Type", "week", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def stored_analysis(spark, sf_dir):
    path, df = shared_path(spark, "analysis"), graded(spark, sf_dir)
    plan = I.imputation_plan(df)
    store.save_analysis(I.impute(df, plan=plan), I.imputation_report(df, plan=plan), path)
    rows, report = store.load_analysis(spark, path)
    filled = report.agg(F.sum("imputed").alias("imputed"))
    return rows.groupBy("verdict", "score").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).join(F.broadcast(filled))


def fills(spark, sf_dir):
    return I.imputation_report(graded(spark, sf_dir)).select("column", "fill")


def loaded_source(spark, sf_dir):
    """One extract, an empty column among its own, read, cleaned and typed."""
    path = shared_path(spark, "extract")
    columns = ["p_partkey", "p_size", "p_type", "p_retailprice", F.lit(None).cast("string").alias("nothing")]
    store.save_text(table(spark, sf_dir, "part").select(*columns), path, ";")
    typed, _ = load_source(spark, path, "out", PART_ROLES)
    return typed.groupBy("p_type").agg(
        F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"), F.lit(len(typed.columns)).alias("n_columns"))


def reloaded_text(spark, sf_dir):
    path, df = shared_path(spark, "saved"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    store.save_text(df, path)
    loaded = read_saved_text(spark, path, dict(df.dtypes))
    return loaded.groupBy("c_mktsegment").agg(F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def skewed_target(spark, sf_dir):
    return N.target_outliers(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").drop("suggestion")


def thin_features(spark, sf_dir):
    """A column with a number only in the dearest lines, one of a single label and one of many small groups."""
    lines = table(spark, sf_dir, "lineitem")
    dearest = lines.agg(F.max("l_extendedprice").alias("dearest"))
    rows = lines.join(F.broadcast(dearest)).select(
        "l_extendedprice", F.col("l_orderkey").cast("string").alias("order"), F.lit("x").alias("flat"),
        F.when(F.col("l_extendedprice") == F.col("dearest"), F.col("l_quantity")).alias("rare"))
    return N.test_warnings(N.feature_tests(rows, "l_extendedprice")).drop("suggestion")


QUERIES = {
    "pivot_metadata_flow": metadata,
    "section_flow": section,
    "cluster_view_flow": view,
    "cluster_store_round_trip": stored_clusters,
    "analysis_store_round_trip": stored_analysis,
    "imputation_fills_graded": fills,
    "load_source_part": loaded_source,
    "saved_text_round_trip": reloaded_text,
    "target_outliers_documents": skewed_target,
    "feature_test_warnings_lineitem": thin_features,
}

_LABELS = " UNION ALL ".join(
    f"SELECT DISTINCT '{n}' AS f, coalesce(nullif(trim({n}), ''), '(en blanco)') AS label, TRY_CAST({n} AS DOUBLE) AS num FROM flow" for n in ("Owner", "Size", "Type"))

SQL = {
    "pivot_metadata_flow": f"""WITH {FLOW_SQL}, v AS ({_LABELS}
        UNION ALL SELECT DISTINCT 'week', coalesce(CAST(week AS VARCHAR), '(en blanco)'), week FROM flow
        UNION ALL SELECT DISTINCT 'value', CASE WHEN value IS NULL THEN '(en blanco)' WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
          ELSE CAST(value AS VARCHAR) END, value FROM flow),
      r AS (SELECT f, label, row_number() OVER (PARTITION BY f ORDER BY label = '(en blanco)', num NULLS LAST, label) AS position, count(*) OVER (PARTITION BY f) > 200 AS cut FROM v),
      e AS (SELECT f, count(num) > 0 AS numbers FROM v GROUP BY f),
      a(p, agg, need) AS (VALUES (0, 'count', ''), (1, 'sum', 'n'), (2, 'mean', 'n'), (3, 'median', 'n'), (4, 'rate_gt_7', 't'), (5, 'rate_gt_14', 't'), (6, 'rate_gt_30', 't')),
      k AS ({k0_sql('flow', profiling.FLOW_COLS)}),
      p AS (SELECT col, count(val) AS d, sum(n) AS rows FROM k GROUP BY col)
      SELECT 'default' AS section, name AS field, CAST(NULL AS INT) AS position, value, CAST(NULL AS VARCHAR) AS detail
        FROM (VALUES ('row_dim', 'Owner'), ('col_dim', 'Size'), ('value_field', 'value'), ('include_blank', 'true'), ('top_k', '10'), ('small_n_threshold', '5')) t(name, value)
      UNION ALL SELECT 'default', 'agg_func', NULL, CASE WHEN numbers THEN 'mean' ELSE 'count' END, NULL FROM e WHERE f = 'value'
      UNION ALL SELECT 'aggregate', f, row_number() OVER (PARTITION BY f ORDER BY p) - 1, agg, NULL FROM e JOIN a ON need = '' OR (need = 'n' AND numbers) OR (need = 't' AND f = 'value')
      UNION ALL SELECT 'option', f, position, label, CASE WHEN cut THEN 'truncated' END FROM r WHERE position <= 200
      UNION ALL SELECT 'warning', f, NULL, 'filter_options_truncated', 'Only the first 200 labels of ''' || f || ''' are offered.' FROM r WHERE cut GROUP BY f
      UNION ALL SELECT 'warning', col, NULL, 'week_constant', 'week does not vary.' FROM p WHERE d <= 1 AND col = 'week'
      UNION ALL SELECT 'warning', col, NULL, 'constant_column', printf('%s is constant (%d distinct).', col, d) FROM p WHERE d <= 1 AND col <> 'week'
      UNION ALL SELECT 'warning', col, NULL, 'high_cardinality', printf('%s has many values (%d distinct, %.2f%% of rows).', col, d, d / rows * 100.0) FROM p
        WHERE d > 1 AND col IN ('Owner', 'Size', 'Type') AND (d > 50 OR d / rows > 0.30)""",
    "section_flow": f"""SELECT 'period' AS part, period AS name, count AS n FROM ({profiling.SQL['period_counts_flow']})
      UNION ALL SELECT 'top', "column" || '=' || value, count FROM ({profiling.SQL['top_categories_flow']})
      UNION ALL SELECT 'categories', "column", total_categories FROM ({profiling.SQL['categorical_profile_flow']})
      UNION ALL SELECT * FROM (WITH {FLOW_SQL}, k AS ({k0_sql('flow', ['row_id', *profiling.FLOW_COLS])})
        SELECT 'identifier', col, count(val) FROM k GROUP BY col HAVING count(val) = sum(n))""",
    "cluster_view_flow": f"""WITH {FLOW_SQL}, g AS (SELECT count(*) AS w FROM flow GROUP BY Type, week),
      o AS (SELECT sum(w) AS n_rows, count(*) AS unique_coordinates, round((1 - count(*) / sum(w)) * 100.0, 4) AS overlap_pct FROM g)
      SELECT w AS display_weight, sum(w) AS n, any_value(n_rows) AS n_rows, any_value(unique_coordinates) AS unique_coordinates, any_value(overlap_pct) AS overlap_pct,
        CASE WHEN any_value(overlap_pct) >= 20 THEN 'projection_high_overlap' END AS code,
        CASE WHEN any_value(overlap_pct) >= 20 THEN printf('%.2f%% of the projected rows coincide with others.', any_value(overlap_pct)) END AS message FROM g, o GROUP BY w""",
    "cluster_store_round_trip": clustering.SQL["density_clusters_flow"],
    "analysis_store_round_trip": f"""SELECT i.*, g.imputed FROM ({profiling.SQL['imputed_graded']}) i,
      (WITH {GRADED_SQL} SELECT 2 * count(*) - count(score) - count(verdict) AS imputed FROM graded) g""",
    "imputation_fills_graded": f"""WITH {GRADED_SQL} SELECT 'score' AS "column", CASE WHEN count(score) < count(*) THEN CAST(quantile_cont(CAST(score AS DOUBLE), 0.5) AS VARCHAR) END AS fill FROM graded
      UNION ALL SELECT 'verdict', (SELECT verdict FROM graded WHERE verdict IS NOT NULL GROUP BY verdict ORDER BY count(*) DESC, verdict LIMIT 1)
      UNION ALL SELECT unnest(['row_id', 'lang', 'source', 'n_chars']), NULL""",
    "load_source_part": "SELECT p_type, count(*) AS n, round(sum(p_retailprice), 2) AS price, 4 AS n_columns FROM part GROUP BY p_type",
    "saved_text_round_trip": "SELECT c_mktsegment, sum(c_custkey) AS keys, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment",
    "target_outliers_documents": """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents),
      s AS (SELECT avg(CASE WHEN n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a) THEN 1.0 ELSE 0.0 END) AS ratio FROM documents, q WHERE n_chars IS NOT NULL)
      SELECT 'target_outliers' AS code, 'warning' AS severity, 'n_chars' AS "column", printf('%.2f%% of the target lies outside the fences.', ratio * 100.0) AS message FROM s WHERE ratio > 0.05""",
    "feature_test_warnings_lineitem": """SELECT 'too_few_rows' AS code, 'warning' AS severity, 'rare' AS "column", 'rare: too few rows for a slope test.' AS message
      FROM lineitem WHERE l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem) HAVING count(l_quantity) BETWEEN 1 AND 2
      UNION ALL SELECT 'too_few_groups', 'warning', 'flat', 'flat: a group test needs two groups.'
      UNION ALL SELECT 'small_groups', 'warning', 'order', printf('order: %d groups with fewer than five rows.', count(*))
        FROM (SELECT l_orderkey FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1 HAVING count(*) < 5) HAVING count(*) > 0""",
}
