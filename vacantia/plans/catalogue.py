"""All queries of the core with their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.plans import label_queries, pipeline_queries, relational_queries, report_queries, timestamp_queries

MODULES = [relational_queries, pipeline_queries, report_queries, label_queries, timestamp_queries]

#: The query that `entry` runs.
FLAGSHIP = "overlap_by_source"

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
