"""Reading the driver's tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data directory; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
