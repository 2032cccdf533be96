"""Incremental ingestion of the observation log as a stream of files.

A micro-batch is appended to the log once: its rows are written under a folder named by the batch's
number with overwrite, so a replayed batch replaces itself. The views derive from the log
afterwards and equal those of one batch over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_of(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, log: str, checkpoint: str) -> None:
    """Drains the stream into the log folder, one subfolder a batch."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_runs(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Runs and rows seen per source and window of event time; rows later than `late` are left out."""
    return stream.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", late).groupBy("source", F.window("at", width).alias("w")).agg(F.count("*").alias("runs"), F.coalesce(F.sum("jobs_seen"), F.lit(0)).alias("jobs_seen"))


def first_sightings(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each posting once, at its first sighting within the watermark."""
    return stream.filter("source is not null and source_id is not null").withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["source", "source_id"])
