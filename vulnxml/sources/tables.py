"""Reading the driver tables (one Parquet file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Tables whose rows carry long texts: per-row work (regexes, tokenising) is heavy.
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    A text table read into fewer partitions than the cluster has cores (one
    file with one row group) is spread round-robin first, so the CPU-heavy
    text work is not done by a single task. Large inputs already have more
    partitions than cores and are left as they are (no extra shuffle)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if name in TEXT_TABLES:
        df = spread(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
