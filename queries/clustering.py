"""Clustering and bundle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.profiling import k0_sql, rounded
from queries.reconciling import SIDE_ROLES, returned
from queries.tables import FLOW_ROLES, FLOW_SQL, SIDES_SQL, arrivals, departures, flow
from tidegauge.operators import bundle as B
from tidegauge.operators import cluster as K

SIDE, MIN_SAMPLES, MIN_SIZE = 0.25, 25, 40


def shape(spark, sf_dir):
    return flow(spark, sf_dir).select("row_id", "Type", "week", "value")


def clustered(spark, sf_dir):
    return K.density_clusters(shape(spark, sf_dir), SIDE, MIN_SAMPLES, MIN_SIZE, ["Type", "week", "value"])


def cluster_counts(spark, sf_dir):
    return clustered(spark, sf_dir).groupBy("Type", "week", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def summary(spark, sf_dir):
    found = K.cluster_summary(clustered(spark, sf_dir), ["Type"], ["week", "value"])
    return rounded(found, digits=6)


def searched(spark, sf_dir):
    return K.cluster_source(flow(spark, sf_dir).select("row_id", "Type", "value")).candidates


def projected(spark, sf_dir):
    found = K.encode(shape(spark, sf_dir), ["Type", "week", "value"])
    points, _ = K.project(found.rows, found.categorical, found.numeric)
    return points.groupBy("Type").agg(F.count("*").alias("n"), F.round(F.avg("pc1"), 4).alias("pc1"), F.round(F.avg("pc2"), 4).alias("pc2"))


def plain_points(spark, sf_dir):
    """Two given coordinates in place of a projection, for the overlap figures."""
    return flow(spark, sf_dir).select("row_id", F.col("value").alias("pc1"), F.col("week").cast("double").alias("pc2"))


def overlap(bucketed):
    return lambda spark, sf_dir: K.overlap_stats(plain_points(spark, sf_dir), bucketed)


def weights(spark, sf_dir):
    return K.point_weights(plain_points(spark, sf_dir)).groupBy("display_weight").agg(F.count("*").alias("n"))


def dictionary(spark, sf_dir):
    documented = spark.createDataFrame([("balance", "number", "money held", "target", None), ("absent", "text", "not there", "x", None)], B.DICTIONARY_SCHEMA)
    return B.variable_dictionary(arrivals(spark, sf_dir), documented).drop("description", "notes", "observed_type")


def exploration(part):
    return lambda spark, sf_dir: rounded(getattr(B.explore(flow(spark, sf_dir), FLOW_ROLES), part), digits=6)


def compared(part):
    return lambda spark, sf_dir: rounded(getattr(B.compare_sources(arrivals(spark, sf_dir).drop("k"), departures(spark, sf_dir).drop("k")), part), digits=6)


def compared_flags(spark, sf_dir):
    columns = ["l_linestatus", "l_linenumber", "l_quantity"]
    return B.compare_sources(returned(spark, sf_dir, "A").select(*columns), returned(spark, sf_dir, "R").select(*columns)).categorical


def facts(spark, sf_dir):
    found = B.build_bundle(arrivals(spark, sf_dir).drop("segment"), departures(spark, sf_dir), SIDE_ROLES)
    return found.facts.select("position", "fact")


QUERIES = {
    "density_clusters_flow": cluster_counts,
    "cluster_summary_flow": summary,
    "cluster_search_flow": searched,
    "projection_flow": projected,
    "overlap_buckets_flow": overlap(True),
    "overlap_rounded_flow": overlap(False),
    "point_weights_flow": weights,
    "variable_dictionary": dictionary,
    "explore_metrics_flow": exploration("global_metrics"),
    "explore_describe_flow": exploration("describe"),
    "compare_sources_numeric": compared("numeric"),
    "compare_sources_categories": compared_flags,
    "bundle_facts": facts,
}

# Components by recursive reachability between dense cells; feasible because cells are few.
CLUSTER_SQL = f"""WITH RECURSIVE {FLOW_SQL},
s AS (SELECT quantile_cont(week, 0.5) AS wm, quantile_cont(week, 0.75) - quantile_cont(week, 0.25) AS wi,
        quantile_cont(value, 0.5) AS vm, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS vi FROM flow),
p AS (SELECT row_id, Type, week, value, CAST(floor((week - wm) / CASE WHEN wi = 0 THEN 1 ELSE wi END / {SIDE}) AS BIGINT) AS cw,
        CAST(floor((value - vm) / CASE WHEN vi = 0 THEN 1 ELSE vi END / {SIDE}) AS BIGINT) AS cv FROM flow, s),
cell AS (SELECT Type, cw, cv, count(*) AS w, row_number() OVER (ORDER BY Type, cw, cv) AS id FROM p GROUP BY Type, cw, cv),
edge AS (SELECT a.id AS a, b.id AS b, b.w AS wb, b.cw AS bw, b.cv AS bv FROM cell a JOIN cell b ON a.Type = b.Type AND abs(a.cw - b.cw) + abs(a.cv - b.cv) = 1),
dens AS (SELECT cell.id, cell.w + coalesce(sum(edge.wb), 0) AS d FROM cell LEFT JOIN edge ON edge.a = cell.id GROUP BY cell.id, cell.w),
core AS (SELECT id FROM dens WHERE d >= {MIN_SAMPLES}),
reach AS (SELECT id AS src, id AS dst FROM core UNION
  SELECT reach.src, edge.b FROM reach JOIN edge ON edge.a = reach.dst JOIN core ON core.id = edge.b),
comp AS (SELECT src AS id, min(dst) AS label FROM reach GROUP BY src),
side AS (SELECT edge.a AS id, comp.label, row_number() OVER (PARTITION BY edge.a ORDER BY wb DESC, bw, bv) AS r
  FROM edge JOIN comp ON comp.id = edge.b WHERE edge.a NOT IN (SELECT id FROM core)),
lab AS (SELECT * FROM comp UNION ALL SELECT id, label FROM side WHERE r = 1),
size AS (SELECT label, sum(w) AS n, min((Type, cw, cv)) AS first FROM lab JOIN cell USING (id) GROUP BY label HAVING sum(w) >= {MIN_SIZE}),
num AS (SELECT label, row_number() OVER (ORDER BY n DESC, first) - 1 AS cluster FROM size),
asg AS (SELECT p.*, coalesce(num.cluster, -1) AS cluster FROM p JOIN cell USING (Type, cw, cv) LEFT JOIN lab USING (id) LEFT JOIN num USING (label))
"""

SQL = {
    "density_clusters_flow": CLUSTER_SQL + "SELECT Type, week, cluster, count(*) AS n, round(sum(value), 2) AS value FROM asg GROUP BY ALL",
    "cluster_summary_flow": CLUSTER_SQL + """, z AS (SELECT cluster, count(*) AS size, round(count(*) / (SELECT count(*) FROM asg) * 100.0, 4) AS pct FROM asg GROUP BY cluster),
      t AS (SELECT cluster, Type, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, Type) AS r FROM asg GROUP BY cluster, Type)
      SELECT cluster, size, pct, 'Type' AS "column", Type AS top_category, CAST(NULL AS DOUBLE) AS mean FROM z JOIN t USING (cluster) WHERE r = 1
      UNION ALL SELECT cluster, any_value(size), any_value(pct), 'week', NULL, round(avg(week), 6) FROM z JOIN asg USING (cluster) GROUP BY cluster
      UNION ALL SELECT cluster, any_value(size), any_value(pct), 'value', NULL, round(avg(value), 6) FROM z JOIN asg USING (cluster) GROUP BY cluster""",
    "overlap_buckets_flow": f"""WITH {FLOW_SQL}, b AS (SELECT greatest(greatest(max(value) - min(value), max(week) - min(week), 1.0) / 55, 0.02) AS side FROM flow)
      SELECT count(*) AS n_rows, count(DISTINCT (round(value / side), round(week / side))) AS unique_coordinates,
        round((1 - count(DISTINCT (round(value / side), round(week / side))) / count(*)) * 100.0, 4) AS overlap_pct FROM flow, b""",
    "overlap_rounded_flow": f"""WITH {FLOW_SQL} SELECT count(*) AS n_rows, count(DISTINCT (round(value, 8), week)) AS unique_coordinates,
        round((1 - count(DISTINCT (round(value, 8), week)) / count(*)) * 100.0, 4) AS overlap_pct FROM flow""",
    "point_weights_flow": f"WITH {FLOW_SQL}, g AS (SELECT count(*) AS display_weight FROM flow GROUP BY round(value, 8), week) SELECT display_weight, sum(display_weight) AS n FROM g GROUP BY display_weight",
    "variable_dictionary": f"WITH {SIDES_SQL}, k AS ({k0_sql('arrivals', ['k', 'nation', 'balance', 'segment'])})" + """
      SELECT col AS "column", CASE WHEN col = 'balance' THEN 'number' ELSE 'observed' END AS logical_type, CASE WHEN col = 'balance' THEN 'target' ELSE 'apoyo' END AS analytical_role,
        round(coalesce(sum(n) FILTER (val IS NULL), 0) / sum(n) * 100.0, 4) AS missing_pct, count(val) AS distinct_values FROM k GROUP BY col""",
    "explore_metrics_flow": f"""WITH {FLOW_SQL} SELECT count(*) AS n_rows, 5 AS n_columns, 5 * count(*) - count(Owner) - count(Size) - count(Type) - count(week) - count(value) AS missing_total,
      round((5 * count(*) - count(Owner) - count(Size) - count(Type) - count(week) - count(value)) / (5 * count(*)) * 100.0, 4) AS missing_pct_total, 3 AS categorical_columns, 2 AS numeric_columns FROM flow""",
    "explore_describe_flow": f"WITH {FLOW_SQL} " + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count({n}) AS n, round(avg({n}), 6) AS mean, round(stddev_samp({n}), 6) AS std, min({n}) * 1.0 AS min, round(quantile_cont({n}, 0.25), 6) AS p25, "
        f"round(quantile_cont({n}, 0.5), 6) AS p50, round(quantile_cont({n}, 0.75), 6) AS p75, max({n}) * 1.0 AS max FROM flow" for n in ("week", "value")),
}


def _bundle_sql():
    from queries.reconciling import SQL as OTHER

    return {
        "compare_sources_numeric": OTHER["compare_numeric"],
        "compare_sources_categories": f"SELECT * FROM ({OTHER['compare_categories']}) WHERE \"column\" <> 'l_quantity'",
    }


SQL.update(_bundle_sql())
