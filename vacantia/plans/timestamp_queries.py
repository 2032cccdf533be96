"""Query of problem 7: normalised timestamps of job postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.operators.timestamps import normalise_timestamps
from vacantia.plans.tables import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, field_name, utc_us of every readable published_at and refreshed_at."""
    return normalise_timestamps(table(spark, sf_dir, "job_postings"), table(spark, sf_dir, "portals"))


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
