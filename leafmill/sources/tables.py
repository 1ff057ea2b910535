"""Scans of the project's tables: one Parquet file or folder per table under a root folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of root/name.parquet. Columns are pruned and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")
