"""Pivot queries on orders, part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.tables import table
from tidegauge.functions.columns import Roles
from tidegauge.operators.pivot import (
    PivotRequest,
    filter_options,
    pivot_warnings,
    run_pivot,
    share_above,
)

ORDERS_ROLES = Roles(key="o_orderkey", target="o_totalprice", categorical=("o_orderpriority",))


def _rounded(matrix):
    return matrix.withColumn("value", F.round("value", 4))


def orders_pivot(agg, **options):
    def run(spark, sf_dir):
        request = PivotRequest("o_orderstatus", "o_orderpriority", "o_totalprice", agg, **options)
        return _rounded(run_pivot(table(spark, sf_dir, "orders"), request, ORDERS_ROLES))

    return run


def brand_pivot(spark, sf_dir):
    request = PivotRequest("p_brand", "p_type", "p_retailprice", "mean", top_k=10, small_n_threshold=12)
    return _rounded(run_pivot(table(spark, sf_dir, "part"), request))


def filtered_pivot(spark, sf_dir):
    filters = {"l_returnflag": ["A", "R"], "l_linenumber": ["1", "2", "3"]}
    request = PivotRequest("l_returnflag", "l_linenumber", "l_quantity", "sum", filters=filters)
    return _rounded(run_pivot(table(spark, sf_dir, "lineitem"), request))


def small_class_pivot(spark, sf_dir):
    labels = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    frame = labels.select("lang", "quality", "n_chars")
    request = PivotRequest("quality", "lang", "n_chars", "median", include_blank=True, top_k=3)
    return _rounded(run_pivot(frame, request))


def no_blank_pivot(spark, sf_dir):
    labels = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    request = PivotRequest("quality", "lang", "n_chars", "mean", include_blank=False)
    return _rounded(run_pivot(labels.select("lang", "quality", "n_chars"), request))


def custom_rate_pivot(spark, sf_dir):
    request = PivotRequest("l_returnflag", "l_linestatus", "l_quantity", "rate_gt_40")
    extra = {"rate_gt_40": share_above(40)}
    return _rounded(run_pivot(table(spark, sf_dir, "lineitem"), request, aggregates=extra))


def empty_pivot(spark, sf_dir):
    request = PivotRequest("l_returnflag", "l_linestatus", "l_quantity", "sum", filters={"l_returnflag": ["?"]})
    return _rounded(run_pivot(table(spark, sf_dir, "lineitem"), request))


def part_filter_options(spark, sf_dir):
    return filter_options(table(spark, sf_dir, "part"), 20)


def part_pivot_warnings(spark, sf_dir):
    request = PivotRequest("p_brand", "p_type", "p_retailprice", "mean", top_k=10)
    return pivot_warnings(table(spark, sf_dir, "part"), request).select("code", "severity", "column")


QUERIES = {
    "pivot_median_orders": orders_pivot("median"),
    "pivot_sum_orders": orders_pivot("sum"),
    "pivot_count_orders": orders_pivot("count"),
    "pivot_mean_orders": orders_pivot("mean"),
    "pivot_rate_orders": orders_pivot("rate_gt_30"),
    "pivot_top_k_brand": brand_pivot,
    "pivot_filtered_lineitem": filtered_pivot,
    "pivot_blank_median_documents": small_class_pivot,
    "pivot_no_blank_documents": no_blank_pivot,
    "pivot_registered_aggregate": custom_rate_pivot,
    "pivot_empty_selection": empty_pivot,
    "pivot_filter_options": part_filter_options,
    "pivot_top_k_warnings": part_pivot_warnings,
}


def cube_sql(base: str, value: str, threshold: int = 5) -> str:
    """Totals from CUBE, cells completed to the full grid."""
    return f"""
WITH base AS ({base}),
t AS (
  SELECT CASE WHEN GROUPING(rk) = 1 AND GROUPING(ck) = 1 THEN 'grand_total'
              WHEN GROUPING(rk) = 1 THEN 'column_total'
              WHEN GROUPING(ck) = 1 THEN 'row_total' ELSE 'cell' END AS level,
         rk AS row_key, ck AS col_key, round({value}, 4) AS value, count(*) AS count
  FROM base GROUP BY CUBE (rk, ck)),
grid AS (
  SELECT r.row_key, k.col_key FROM (SELECT row_key FROM t WHERE level = 'row_total') r,
         (SELECT col_key FROM t WHERE level = 'column_total') k)
SELECT 'cell' AS level, g.row_key, g.col_key, t.value, coalesce(t.count, 0) AS count,
       coalesce(t.count, 0) < {threshold} AS low_sample
FROM grid g LEFT JOIN t ON t.level = 'cell' AND t.row_key = g.row_key AND t.col_key = g.col_key
UNION ALL
SELECT level, row_key, col_key, value, count, CAST(NULL AS BOOLEAN) FROM t WHERE level <> 'cell'
"""


_ORDERS = "SELECT o_orderstatus AS rk, o_orderpriority AS ck, o_totalprice AS v FROM orders"
_LINES = "SELECT l_returnflag AS rk, l_linestatus AS ck, l_quantity AS v FROM lineitem"
_TOP_BRANDS = """
SELECT CASE WHEN b.p_brand IS NULL THEN 'Other' ELSE p.p_brand END AS rk, p.p_type AS ck, p.p_retailprice AS v
FROM part p LEFT JOIN (
  SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10) b ON p.p_brand = b.p_brand
"""
_BLANK = """
WITH d AS (SELECT coalesce(CAST(l.quality AS VARCHAR), '(en blanco)') AS rk, d.lang AS ck, d.n_chars AS v
           FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT ck FROM d GROUP BY ck ORDER BY count(*) DESC, ck LIMIT 3)
SELECT rk, CASE WHEN k.ck IS NULL THEN 'Other' ELSE d.ck END AS ck, v FROM d LEFT JOIN k ON d.ck = k.ck
"""
_NO_BLANK = """
SELECT CAST(l.quality AS VARCHAR) AS rk, d.lang AS ck, d.n_chars AS v
FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL
"""

SQL = {
    "pivot_median_orders": cube_sql(_ORDERS, "quantile_cont(v, 0.5)"),
    "pivot_sum_orders": cube_sql(_ORDERS, "sum(v)"),
    "pivot_count_orders": cube_sql(_ORDERS, "CAST(count(*) AS DOUBLE)"),
    "pivot_mean_orders": cube_sql(_ORDERS, "avg(v)"),
    "pivot_rate_orders": cube_sql(_ORDERS, "100.0 * avg(CASE WHEN v > 30 THEN 1.0 ELSE 0.0 END)"),
    "pivot_top_k_brand": cube_sql(_TOP_BRANDS, "avg(v)", 12),
    "pivot_filtered_lineitem": cube_sql(
        "SELECT l_returnflag AS rk, CAST(l_linenumber AS VARCHAR) AS ck, l_quantity AS v FROM lineitem "
        "WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 2, 3)", "sum(v)"),
    "pivot_blank_median_documents": cube_sql(_BLANK, "quantile_cont(v, 0.5)"),
    "pivot_no_blank_documents": cube_sql(_NO_BLANK, "avg(v)"),
    "pivot_registered_aggregate": cube_sql(_LINES, "100.0 * avg(CASE WHEN v > 40 THEN 1.0 ELSE 0.0 END)"),
    "pivot_empty_selection": """
SELECT 'grand_total' AS level, CAST(NULL AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS col_key,
       sum(l_quantity) AS value, count(*) AS count, CAST(NULL AS BOOLEAN) AS low_sample
FROM lineitem WHERE l_returnflag = '?'
""",
    "pivot_filter_options": """
WITH v AS (
  SELECT DISTINCT 'p_partkey' AS "column", CAST(p_partkey AS VARCHAR) AS label, CAST(p_partkey AS DOUBLE) AS num FROM part
  UNION ALL SELECT DISTINCT 'p_name', trim(p_name), NULL FROM part
  UNION ALL SELECT DISTINCT 'p_brand', p_brand, NULL FROM part
  UNION ALL SELECT DISTINCT 'p_type', p_type, NULL FROM part
  UNION ALL SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR), CAST(p_size AS DOUBLE) FROM part
  UNION ALL SELECT DISTINCT 'p_retailprice',
    CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR)
         ELSE CAST(p_retailprice AS VARCHAR) END, p_retailprice FROM part),
r AS (SELECT "column", label, row_number() OVER (PARTITION BY "column" ORDER BY num NULLS LAST, label) AS position,
             count(*) OVER (PARTITION BY "column") > 20 AS truncated FROM v)
SELECT * FROM r WHERE position <= 20
""",
    "pivot_top_k_warnings": """
SELECT 'top_k_applied' AS code, 'info' AS severity, 'p_brand' AS "column" FROM part HAVING count(DISTINCT p_brand) > 10
UNION ALL
SELECT 'top_k_applied', 'info', 'p_type' FROM part HAVING count(DISTINCT p_type) > 10
""",
}
