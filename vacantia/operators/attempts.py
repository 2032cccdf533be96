"""Verification runs with nested attempts: figures over them and their flat pages.

A run has `attempts`: an array of struct<url, origin, source, accepted, page_snapshots: array<struct<url,
status_code, content_sha256>>>, in order, and `page_snapshots` of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.rounding import ratio


def attempt_metrics(runs: DataFrame) -> DataFrame:
    """Per source of source-given candidates: attempts, accepted, rejected and the accepted share."""
    a = runs.select(F.explode("attempts").alias("a")).filter("a.origin = 'source_candidate'")
    g = a.groupBy(F.col("a.source").alias("source")).agg(F.count("*").alias("attempts"), F.count_if(F.col("a.accepted")).alias("accepted"))
    return g.select("source", "attempts", "accepted", (F.col("attempts") - F.col("accepted")).alias("rejected"), ratio(F.col("accepted"), F.col("attempts")).alias("accepted_rate"))


def search_fallbacks(runs: DataFrame) -> DataFrame:
    """Runs in which a search attempt comes after the first rejected candidate of a source."""
    at = F.transform("attempts", lambda a, i: F.when((a["origin"] == "source_candidate") & ~a["accepted"], i))
    first = F.array_min(F.array_compact(at))
    after = F.exists(F.transform("attempts", lambda a, i: F.struct(i.alias("i"), (a["origin"] == "search").alias("s"))), lambda x: x["s"] & (x["i"] > first))
    return runs.filter(F.coalesce(after, F.lit(False))).select("run_id")


def flat_pages(runs: DataFrame) -> DataFrame:
    """run_id, attempt_index, page_index and the page: pages of the attempts, or the run's own where it has none."""
    some = runs.filter(F.size("attempts") > 0).select("run_id", F.posexplode("attempts").alias("attempt_index", "a")).select("run_id", "attempt_index", F.posexplode("a.page_snapshots").alias("page_index", "p"))
    own = runs.filter(F.coalesce(F.size("attempts"), F.lit(0)) <= 0).select("run_id", F.lit(None).cast("int").alias("attempt_index"), F.posexplode("page_snapshots").alias("page_index", "p"))
    return some.unionByName(own).select("run_id", "attempt_index", "page_index", "p.*")
