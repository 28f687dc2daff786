"""Bindings of the flow-table roles to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.columns import Roles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ``events`` plays the departures history: five weeks, one skewed target, three category columns.
FLOW_ROLES = Roles(
    key="row_id", target="value", period="week", class_code="Size", categorical=("Owner", "Type", "Size")
)


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    days = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return events.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("Owner"),
        F.floor(k / 25).cast("string").alias("Size"),
        F.col("event_type").alias("Type"),
        (F.floor(days / 7) + 1).cast("int").alias("week"),
        F.col("value"),
    )


FLOW_SQL = """
flow AS (
  SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS Owner,
         CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS INT) / 25.0) AS BIGINT) AS VARCHAR) AS Size,
         event_type AS Type,
         CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INT) + 1 AS week,
         value
  FROM events)
"""

# IN side and OUT side of the reconciliation queries.
SIDES_SQL = """
arrivals AS (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer),
departures AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_acctbal AS balance FROM supplier)
"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
