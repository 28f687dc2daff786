"""Sinks, reloads, previews and descriptors of stored datasets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.columns import c

MAX_PREVIEW = 200
SAMPLE_ROWS = 8


def save_table(df: DataFrame, path: str, period: str | None = None) -> None:
    """Columnar sink; a period column becomes the partition folder so period filters prune files."""
    writer = df.write.mode("overwrite")
    if period and period in df.columns:
        writer = writer.partitionBy(period)
    writer.parquet(path)


def save_text(df: DataFrame, path: str, separator: str = ",", encoding: str = "UTF-8") -> None:
    (df.write.mode("overwrite").option("header", True).option("sep", separator).option("encoding", encoding)
     .option("escape", '"').csv(path))


def save_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string").write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_dataset(df: DataFrame, path: str, metadata: dict, period: str | None = None) -> None:
    """Canonical dataset: the table plus its descriptor."""
    save_table(df, f"{path}/canonical", period)
    save_metadata(df.sparkSession, {**metadata, "columns": df.columns, "dtypes": dict(df.dtypes)}, f"{path}/metadata")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    metadata = load_metadata(spark, f"{path}/metadata")
    df = spark.read.parquet(f"{path}/canonical")
    return df.select(*[c(n) for n in metadata["columns"]]), metadata


def save_clusters(assignment: DataFrame, summary: DataFrame, path: str) -> None:
    save_table(assignment, f"{path}/assignment")
    save_table(summary, f"{path}/summary")


def load_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/assignment"), spark.read.parquet(f"{path}/summary")


def save_analysis(imputed: DataFrame, report: DataFrame, path: str, period: str | None = None) -> None:
    """Analysis copy of a source beside the report of what was filled."""
    save_table(imputed, f"{path}/analysis", period)
    save_table(report, f"{path}/imputation")


def load_analysis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/analysis"), spark.read.parquet(f"{path}/imputation")


def preview(df: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """First rows by key. Spark tables have no row order, so the key is explicit."""
    if not 1 <= limit <= MAX_PREVIEW:
        raise ValueError(f"limit must lie between 1 and {MAX_PREVIEW}")
    return df.orderBy(c(key)).limit(limit)


def sample_rows(df: DataFrame, key: str) -> DataFrame:
    return preview(df, key, SAMPLE_ROWS)


def descriptor(df: DataFrame, target: str | None = None) -> DataFrame:
    """Row count, position and type of every column, and whether it is the target."""
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(f.metadata.get("semantic_type")).alias("semantic_type"), F.lit(f.name == target).alias("is_target"),
            F.col("n_rows"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(F.array(*rows)))
