"""Ingest, reconciliation and two-sided comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.profiling import GRADED_SQL, graded, k0_sql, rounded
from queries.tables import SIDES_SQL, arrivals, departures, table
from tidegauge.functions.columns import Roles
from tidegauge.operators import compare as C
from tidegauge.operators.clean import clean
from tidegauge.operators.ingest import ingest
from tidegauge.operators.merge import merge, unmatched
from tidegauge.operators.quality import route_pipeline_warnings
from tidegauge.operators.typing import cast_types, semantic_types
from tidegauge.plans.sizing import shared_path
from tidegauge.sources import store
from tidegauge.sources.delimited import read_delimited, read_report, sniff

SIDE_ROLES = Roles(key="k", target="balance", overlap=("nation", "balance"), categorical=("segment",))


def merged(spark, sf_dir):
    return merge(arrivals(spark, sf_dir), departures(spark, sf_dir), SIDE_ROLES)


def merge_agreeing(spark, sf_dir):
    """Both sides from lineitem keys of orders: the shared column agrees on every row."""
    orders = table(spark, sf_dir, "orders")
    left = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("nation"), "o_totalprice")
    right = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("nation"), "o_custkey")
    found = merge(left, right, SIDE_ROLES).table
    return found.groupBy("nation").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys"))


def csv_copy(spark, sf_dir, name, columns, separator=";", encoding="UTF-8"):
    path = shared_path(spark, "extract")
    store.save_text(table(spark, sf_dir, name).select(*columns), path, separator, encoding)
    return path


def csv_round_trip(spark, sf_dir):
    path = csv_copy(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    cleaned, _, _ = clean(read_delimited(spark, path), "in_file")
    typed, _ = cast_types(cleaned, "in_file", Roles(target="c_acctbal", period="c_nationkey", categorical=("c_mktsegment",)))
    return typed.groupBy("c_mktsegment", "c_nationkey").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def csv_report(spark, sf_dir):
    path = csv_copy(spark, sf_dir, "conversations", ["conv_id", "turn", "role"], "|")
    form = sniff(spark, path)
    return read_report(read_delimited(spark, path, form), path, form).drop("filename")


def csv_semantics(spark, sf_dir):
    path = csv_copy(spark, sf_dir, "part", ["p_partkey", "p_size", "p_type", "p_retailprice"], "\t")
    cleaned, _, _ = clean(read_delimited(spark, path), "out_file")
    typed, _ = cast_types(cleaned, "out_file", Roles(class_code="p_size", target="p_retailprice", categorical=("p_type",)))
    return semantic_types(typed)


def ingest_pair(spark, sf_dir):
    """The whole ingest on two delimited extracts that share keys."""
    left = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("Type"), F.col("o_orderpriority").alias("Quality"))
    right = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("Type"), F.col("o_totalprice").alias("DaysInDeposit"))
    paths = []
    for frame, separator in ((left, ";"), (right, "|")):
        paths.append(shared_path(spark, "extract"))
        store.save_text(frame, paths[-1], separator)
    flow = ingest(spark, *paths)
    return flow.merged.groupBy("Type", "Quality").agg(
        F.count("*").alias("n"), F.round(F.sum("DaysInDeposit"), 2).alias("days"))


def ingest_warnings(spark, sf_dir):
    path = csv_copy(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    flow = ingest(spark, None, path)
    return route_pipeline_warnings(flow.warnings, "out").select("code", "severity")


def split(spark, sf_dir):
    numeric, categories = C.split_shared(arrivals(spark, sf_dir), departures(spark, sf_dir))
    rows = [(n, "numeric") for n in numeric] + [(n, "categorical") for n in categories]
    return spark.createDataFrame(rows, "column string, compared_as string")


def compared_numbers(spark, sf_dir):
    return rounded(C.compare_numeric(arrivals(spark, sf_dir), departures(spark, sf_dir), ["nation", "balance"]), digits=6)


def returned(spark, sf_dir, flag):
    """Lines with the flag, or with any other flag for the other side: both sides together are the whole table."""
    same = F.col("l_returnflag").eqNullSafe("A")
    return table(spark, sf_dir, "lineitem").filter(same if flag == "A" else ~same)


def compared_categories(spark, sf_dir):
    return C.compare_categories(returned(spark, sf_dir, "A"), returned(spark, sf_dir, "R"), ["l_linestatus", "l_linenumber", "l_quantity"])


def saved_and_loaded(spark, sf_dir):
    path = shared_path(spark, "dataset")
    store.save_dataset(graded(spark, sf_dir), path, {"source": "graded"}, period="lang")
    loaded, _ = store.load_dataset(spark, path)
    return loaded.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


QUERIES = {
    "merge_table_conflict": lambda s, d: rounded(merged(s, d).table, digits=4),
    "merge_report": lambda s, d: merged(s, d).report,
    "merge_warnings": lambda s, d: merged(s, d).warnings.select("code", "severity"),
    "merge_agreeing_overlap": merge_agreeing,
    "merge_unmatched_out": lambda s, d: unmatched(arrivals(s, d), departures(s, d), "k"),
    "merge_passthrough": lambda s, d: merge(None, departures(s, d), SIDE_ROLES).report.select("mode", "merged_rows"),
    "delimited_round_trip": csv_round_trip,
    "delimited_report": csv_report,
    "semantic_types_part": csv_semantics,
    "ingest_pair": ingest_pair,
    "ingest_warnings": ingest_warnings,
    "store_round_trip": saved_and_loaded,
    "preview_orders": lambda s, d: store.preview(table(s, d, "orders"), "o_orderkey", 20),
    "sample_rows_orders": lambda s, d: store.sample_rows(table(s, d, "orders"), "o_orderkey"),
    "descriptor_customer": lambda s, d: store.descriptor(table(s, d, "customer"), "c_acctbal"),
    "compare_split": split,
    "compare_numeric": compared_numbers,
    "compare_categories": compared_categories,
}

_AR = f"(SELECT * FROM lineitem WHERE l_returnflag = 'A')"
_CMP = ["l_linestatus", "l_linenumber", "l_quantity"]


def _numeric_side(source, prefix):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", round(avg({n}), 6) AS {prefix}_mean, round(quantile_cont({n}, 0.5), 6) AS {prefix}_median, "
        f"round(stddev_samp({n}), 6) AS {prefix}_std, min({n}) * 1.0 AS {prefix}_min, max({n}) * 1.0 AS {prefix}_max FROM {source}"
        for n in ("nation", "balance"))


SQL = {
    "merge_table_conflict": f"""WITH {SIDES_SQL} SELECT CAST(a.k AS VARCHAR) AS k, a.nation AS nation_in, a.balance AS balance_in, a.segment,
      d.nation AS nation_out, d.balance AS balance_out FROM arrivals a JOIN departures d USING (k)""",
    "merge_report": f"""WITH {SIDES_SQL} SELECT 'merged' AS mode, (SELECT count(*) FROM arrivals) AS input_in_rows, (SELECT count(*) FROM departures) AS input_out_rows,
      (SELECT count(*) FROM arrivals JOIN departures USING (k)) AS merged_rows,
      (SELECT count(*) FROM arrivals WHERE k NOT IN (SELECT k FROM departures)) AS unmatched_in_rows,
      (SELECT count(*) FROM departures WHERE k NOT IN (SELECT k FROM arrivals)) AS unmatched_out_rows""",
    "merge_warnings": f"""WITH {SIDES_SQL} SELECT 'overlap_column_conflict' AS code, 'info' AS severity FROM arrivals a JOIN departures d USING (k)
      HAVING count_if(a.nation IS DISTINCT FROM d.nation OR a.balance IS DISTINCT FROM d.balance) > 0""",
    "merge_agreeing_overlap": "SELECT o_orderstatus AS nation, count(*) AS n, sum(o_custkey) AS custkeys FROM orders GROUP BY 1",
    "merge_unmatched_out": f"WITH {SIDES_SQL} SELECT * FROM arrivals WHERE k NOT IN (SELECT k FROM departures)",
    "merge_passthrough": "SELECT 'passthrough' AS mode, count(*) AS merged_rows FROM supplier",
    "delimited_round_trip": "SELECT c_mktsegment, CAST(c_nationkey AS DOUBLE) AS c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1, 2",
    "delimited_report": "SELECT 'utf-8' AS encoding, '|' AS separator, count(*) AS n_rows, 3 AS n_columns FROM conversations",
    "semantic_types_part": """SELECT 'Unnamed: 0' AS "column", 'categorical' AS semantic_type UNION ALL SELECT 'p_type', 'categorical' UNION ALL SELECT 'p_retailprice', 'numeric_target'
      UNION ALL SELECT 'p_size', CASE WHEN count(DISTINCT p_size) <= 12 AND count(DISTINCT p_size) / count(*) <= 0.1 THEN 'categorical_discrete' ELSE 'numeric' END FROM part""",
    "ingest_pair": "SELECT o_orderstatus AS Type, o_orderpriority AS Quality, count(*) AS n, round(sum(o_totalprice), 2) AS days FROM orders GROUP BY 1, 2",
    "ingest_warnings": "SELECT 'missing_expected_columns_out' AS code, 'warning' AS severity",
    "store_round_trip": f"WITH {GRADED_SQL} SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM graded GROUP BY lang",
    "preview_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20",
    "sample_rows_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 8",
    "descriptor_customer": " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS \"column\", '{t}' AS dtype, CAST(NULL AS VARCHAR) AS semantic_type, {str(n == 'c_acctbal').lower()} AS is_target, count(*) AS n_rows FROM customer"
        for i, (n, t) in enumerate([("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")])),
    "compare_split": f"""WITH {SIDES_SQL} SELECT n AS "column", CASE WHEN d > 12 THEN 'numeric' ELSE 'categorical' END AS compared_as FROM (
      SELECT 'nation' AS n, greatest((SELECT count(DISTINCT nation) FROM arrivals), (SELECT count(DISTINCT nation) FROM departures)) AS d
      UNION ALL SELECT 'balance', greatest((SELECT count(DISTINCT balance) FROM arrivals), (SELECT count(DISTINCT balance) FROM departures))
      UNION ALL SELECT 'k', greatest((SELECT count(DISTINCT k) FROM arrivals), (SELECT count(DISTINCT k) FROM departures)))""",
    "compare_numeric": f"WITH {SIDES_SQL}, i AS ({_numeric_side('arrivals', 'in')}), o AS ({_numeric_side('departures', 'out')}) SELECT * FROM i FULL JOIN o USING (\"column\")",
    "compare_categories": f"""WITH i AS ({k0_sql(_AR, _CMP)}), o AS ({k0_sql(_AR.replace("= 'A'", "IS DISTINCT FROM 'A'"), _CMP)}),
      j AS (SELECT coalesce(i.col, o.col) AS "column", coalesce(i.val, o.val) AS category, coalesce(i.n, 0) AS in_count, coalesce(o.n, 0) AS out_count FROM i FULL JOIN o ON i.col = o.col AND i.val = o.val),
      r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY in_count + out_count DESC, category) AS rank FROM j)
      SELECT "column", rank, category, in_count, round(in_count / (SELECT count(*) FROM {_AR}) * 100.0, 4) AS in_pct, out_count,
        round(out_count / (SELECT count(*) FROM {_AR.replace("= 'A'", "IS DISTINCT FROM 'A'")}) * 100.0, 4) AS out_pct FROM r WHERE rank <= 10""",
}
