"""Current views over append-only logs: latest rows, accumulated keys, upserts, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The last `n` rows of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if isinstance(o, str) else o for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def last_values(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The values of the last row of each key. An aggregate: it combines before its shuffle, so hot keys are cheap."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])


def current_postings(log: DataFrame) -> DataFrame:
    """One row per (source, source_id): the values of the last sighting, and when first and last seen.

    Sightings without a source_id belong to no posting of the view.
    """
    values = ["url", "title", "company_name_raw", "city", "description", "published_at", "refreshed_at"]
    order = F.struct("observed_at", "id")
    keyed = log.filter("source is not null and source_id is not null")
    out = keyed.groupBy("source", "source_id").agg(
        F.max_by(F.struct("id", *values), order).alias("_last"), F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.count("*").alias("sightings")
    )
    return out.select("source", "source_id", F.col("_last.id").alias("observation_id"), *[F.col(f"_last.{v}").alias(v) for v in values], "first_seen_at", "last_seen_at", "sightings")


def upsert_stats(log: DataFrame) -> DataFrame:
    """Per source how many sightings were the first of their posting and how many came later."""
    keyed = log.filter("source is not null and source_id is not null").groupBy("source", "source_id").agg(F.count("*").alias("n"))
    return keyed.groupBy("source").agg(F.sum("n").alias("seen"), F.count("*").alias("inserted"), (F.sum("n") - F.count("*")).alias("updated"))


def accumulated_aliases(postings: DataFrame) -> DataFrame:
    """(company_id, alias): best confidence and the source that last gave it, first and last sight."""
    named = postings.filter("company_id is not null and company_name_raw is not null")
    return named.groupBy("company_id", F.col("company_name_raw").alias("alias")).agg(
        F.max("company_name_confidence").alias("confidence"), F.max_by("source", F.struct("company_name_confidence", "id")).alias("source"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )


def accumulated_locations(postings: DataFrame, folded_city: Column) -> DataFrame:
    """(company_id, normalized_city): the first spelling, first and last sight."""
    c = postings.filter("company_id is not null").withColumn("normalized_city", folded_city).filter("normalized_city <> ''")
    return c.groupBy("company_id", "normalized_city").agg(F.min_by("city", F.struct("first_seen_at", "id")).alias("city"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def accumulated_identifiers(observed: DataFrame, kind: Column, value: Column) -> DataFrame:
    """(company_id, kind, value) of valid identifiers: best confidence, sightings, last source."""
    v = observed.withColumn("_kind", kind).withColumn("_value", value).filter("company_id is not null and _kind is not null and _value is not null")
    return v.groupBy("company_id", F.col("_kind").alias("kind"), F.col("_value").alias("value")).agg(
        F.max("confidence").alias("confidence"), F.sum("observation_count").alias("observations"), F.max_by("evidence_source", F.struct("last_seen_at", "id")).alias("evidence_source")
    )


def identifier_conflicts(current: DataFrame) -> DataFrame:
    """Identifiers that several companies hold."""
    g = current.groupBy("kind", "value").agg(F.count_distinct("company_id").alias("company_count"), F.max("confidence").alias("max_confidence"), F.min("company_id").alias("first_company_id"))
    return g.filter("company_count > 1")


def conflicting_rows(current: DataFrame) -> DataFrame:
    """Rows whose identifier another company holds too (from the extremes, not by a self-join)."""
    span = current.groupBy("kind", "value").agg(F.min("company_id").alias("_lo"), F.max("company_id").alias("_hi")).filter("_lo <> _hi")
    return current.join(span, ["kind", "value"]).drop("_lo", "_hi")


def changes(snapshots: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Each row with the previous value of its key and whether it differs; the first of a key never does."""
    w = Window.partitionBy(key).orderBy(*order)
    return snapshots.withColumn("previous", F.lag(value).over(w)).withColumn("changed", F.coalesce(F.col("previous") != F.col(value), F.lit(False)))


def until_first_accepted(attempts: DataFrame, key: str, rank: str, accepted: str) -> DataFrame:
    """Ranked attempts up to and with the first accepted one; all of them where none is."""
    first = F.min(F.when(F.col(accepted), F.col(rank))).over(Window.partitionBy(key))
    return attempts.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(rank) <= F.col("_first"))).drop("_first")
