"""Figures per source: runs, health, identity, provenance, what follows from its postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.rounding import ratio


def run_metrics(runs: DataFrame) -> DataFrame:
    """Counts, seen rows and durations (in microseconds, whole numbers) of each source's runs."""
    took = F.unix_micros("finished_at") - F.unix_micros("started_at")
    g = runs.groupBy("source").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.coalesce(F.sum("jobs_seen"), F.lit(0)).alias("jobs_seen"), F.coalesce(F.sum("jobs_inserted"), F.lit(0)).alias("jobs_inserted"), F.count("finished_at").alias("finished"), F.sum(took).alias("total_us"),
    )
    return g.select("*", ratio(F.col("successes"), F.col("runs")).alias("success_rate"), ratio(F.col("total_us"), F.col("jobs_seen")).alias("us_per_job_seen"))


def health(names: DataFrame, runs: DataFrame) -> DataFrame:
    """State of every listed source from its last run: unexercised, blocked, failing, empty or healthy."""
    blocked = F.coalesce(F.col("error_message"), F.lit("")).rlike(r"\b(401|403|429)\b|robots")
    folded = runs.groupBy("source").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.max_by(F.struct("status", "jobs_seen", "error_type", blocked.alias("blocked")), "id").alias("last"), F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success_at"),
        F.max_by("error_type", F.when(F.col("error_type").isNotNull(), F.col("id"))).alias("last_error"),
    )
    out = names.join(folded, "source", "left")
    state = (
        F.when(F.col("last").isNull(), "unexercised").when((F.col("last.status") != "success") & F.col("last.blocked"), "blocked").when(F.col("last.status") != "success", "failing")
        .when(F.coalesce("last.jobs_seen", F.lit(0)) == 0, "empty").otherwise("healthy")
    )
    return out.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "successes", "failures")], F.col("last.status").alias("last_status"), "last_success_at", "last_error", state.alias("state"))


def identity_metrics(postings: DataFrame) -> DataFrame:
    """How well each source names the firms of its postings, and how they were resolved."""
    p = postings.select(F.lower(F.trim("source")).alias("source"), "company_id", F.nullif(F.trim("company_name_raw"), F.lit("")).alias("name"), F.nullif(F.trim("city"), F.lit("")).alias("city"), F.col("company_name_confidence").cast("decimal(6,4)").alias("confidence"), F.coalesce("company_resolution_method", F.lit("legacy")).alias("method"))
    g = p.groupBy("source").agg(
        F.count("*").alias("postings"), F.count("name").alias("named"), F.count("city").alias("placed"), F.count("company_id").alias("resolved"), F.count_distinct("company_id").alias("companies"),
        F.count_if(F.col("confidence") >= 0.8).alias("sure"), F.sum("confidence").cast("double").alias("confidence_sum"),
        F.count_if(F.col("method").isin("new_company", "ambiguous_exact_name", "insufficient_cross_city_evidence")).alias("created"),
    )
    return g.select("*", ratio(F.col("named"), F.col("postings")).alias("named_rate"), ratio(F.col("resolved"), F.col("postings")).alias("resolved_rate"))


def resolution_methods(postings: DataFrame) -> DataFrame:
    p = postings.select(F.coalesce("company_resolution_method", F.lit("legacy")).alias("method"), F.col("company_resolution_confidence").cast("decimal(6,4)").alias("c"))
    return p.groupBy("method").agg(F.count("*").alias("postings"), F.sum("c").cast("double").alias("confidence_sum"), F.count("c").alias("with_confidence"))


def provenance(identifiers: DataFrame, postings: DataFrame) -> DataFrame:
    """Per source: its postings beside the identifiers it has given; sources of either side appear.

    Both sides are aggregated before they meet, so nothing fans out.
    """
    i = identifiers.groupBy(F.col("job_source").alias("source")).agg(
        F.count("*").alias("identifier_rows"), F.sum("observation_count").alias("observations"), F.count_distinct("company_id").alias("identified_companies"),
        F.count_if(F.lower("kind").isin("nip", "regon", "krs")).alias("register_rows"), F.count_if(F.col("confidence") >= 0.95).alias("strong_rows"),
    )
    p = postings.groupBy("source").agg(F.count("*").alias("postings"), F.count_distinct("company_id").alias("companies"))
    out = p.join(i, "source", "full_outer").na.fill(0)
    return out.withColumn("identified_rate", ratio(F.col("identified_companies"), F.col("companies")))


def downstream(postings: DataFrame, companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per source the companies its postings lead to, with websites and usable contacts."""
    pairs = postings.filter("company_id is not null").select("source", "company_id").distinct()
    c = companies.select(F.col("id").alias("company_id"), F.col("website_url").isNotNull().alias("site"), F.col("enriched_at").isNotNull().alias("enriched"))
    g = contacts.groupBy("company_id").agg(F.count_if(F.col("decision") == "green").alias("green"), F.count("*").alias("contacts"))
    j = pairs.join(c, "company_id").join(g, "company_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("companies"), F.count_if("site").alias("with_site"), F.count_if("enriched").alias("enriched"), F.coalesce(F.sum("contacts"), F.lit(0)).alias("contacts"), F.count_if(F.col("green") > 0).alias("with_green"),
    )
