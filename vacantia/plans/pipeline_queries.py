"""Queries of the stateful, textual and streaming operators; SQL where it can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.discover import websites
from vacantia.functions import identifiers, urls
from vacantia.html.channels import channels_of_pages
from vacantia.operators import state
from vacantia.plans.relational_queries import SQL as RELATIONAL_SQL
from vacantia.plans.relational_queries import fold_sql, host_sql
from vacantia.plans.tables import table
from vacantia.resolve import fold
from vacantia.rules.classify import classified
from vacantia.session import ensure_checkpoint_dir
from vacantia.streaming import ingest


def resolved_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Every posting folded in the order of its identifier."""
    return fold.resolve(table(spark, sf, "job_postings"))


def resolved_with_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the strong identifier of each posting's company: of those of 0.95 or surer the least, valid by its kind."""
    o = table(spark, sf, "company_identifier_observations")
    kind = identifiers.identifier_kind(F.col("kind"))
    value = identifiers.identifier_value(kind, F.col("value"))
    sure = o.select("company_id", kind.alias("k"), value.alias("v"), "confidence").filter(F.col("v").isNotNull() & identifiers.is_strong(F.col("k"), F.col("confidence")))
    strong = sure.groupBy("company_id").agg(F.min(F.concat_ws(":", "k", "v")).alias("strong"))
    return fold.resolve(table(spark, sf, "job_postings").join(strong, "company_id", "left"), strong="strong")


def resolved_companies(spark: SparkSession, sf: str) -> DataFrame:
    r = fold.resolve(table(spark, sf, "job_postings"))
    return r.groupBy("company_seq", "company_key").agg(F.count("*").alias("postings"), F.count_if(F.col("created")).alias("made")).select("*")


def evidence_classified(spark: SparkSession, sf: str) -> DataFrame:
    s, k = table(spark, sf, "contact_evidence_snapshots"), table(spark, sf, "contact_channels")
    j = s.join(k.select(F.col("id").alias("contact_channel_id"), "value"), "contact_channel_id")
    return j.select("id", classified(F.concat_ws(" ", "evidence_text", "evidence_url"), F.col("value")).alias("c")).select("id", "c.*")


def channels_from_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Channels found in evidence texts taken as pages."""
    s = table(spark, sf, "contact_evidence_snapshots").filter("evidence_text is not null")
    return channels_of_pages(s.select(F.col("evidence_url").alias("url"), F.concat(F.lit("<p>"), F.col("evidence_text"), F.lit("</p>")).alias("html")))


def urls_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "job_postings").select("id", urls.canonical_urls("url").alias("url"))


def website_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "companies").select("id", urls.website_candidates("website_url").alias("c")).select("id", "c.url", "c.host").filter("host is not null")


def websites_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The three likeliest own addresses of each company among its evidence, by name, place and host."""
    k, c = table(spark, sf, "contact_channels"), table(spark, sf, "companies")
    found = k.select("company_id", F.col("evidence_signal").alias("title"), F.col("value").alias("snippet"), F.col("evidence_url").alias("url")).join(c.select(F.col("id").alias("company_id"), F.col("canonical_name").alias("name"), "city"), "company_id")
    return websites.ranked_candidates(found).select("company_id", "url", "score", "rank")


def _table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files. The path is a pattern, as a stream's plain path must be a folder, and a table may be one file."""
    return ingest.stream_of(spark, f"{sf}/[{name[0]}]{name[1:]}.parquet", table(spark, sf, name).schema)


def stream_run_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Runs per source and day from a stream, as they stand when it is drained."""
    stream = _table_stream(spark, sf, "source_runs")
    name = f"runs_{uuid.uuid4().hex}"
    out = ingest.windowed_runs(stream, late="3650 days")
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("source", F.unix_micros("w.start").alias("day_us"), "runs", "jobs_seen")


def stream_jobs_current(spark: SparkSession, sf: str) -> DataFrame:
    """The current view over a log that was ingested as a stream."""
    base = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    source = table(spark, sf, "job_posting_observations")
    ingest.ingest(_table_stream(spark, sf, "job_posting_observations"), f"{base}/log", f"{base}/state")
    return state.current_postings(spark.read.schema(source.schema).parquet(f"{base}/log"))


QUERIES = {f.__name__: f for f in (resolved_postings, resolved_with_identifiers, resolved_companies, evidence_classified, channels_from_evidence, urls_canonical, website_candidates, websites_ranked, stream_run_windows, stream_jobs_current)}
_STOP = ", ".join(f"'{w}'" for w in sorted(websites.STOP_WORDS))
_BLOCKED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in sorted(websites.BLOCKED_HOSTS))
_RANKED = f"""
    WITH b AS (
        SELECT k.id, company_id, canonical_name AS name, {fold_sql("coalesce(c.city, '')")} AS place, evidence_signal AS title, value AS snippet, evidence_url AS url, {host_sql("evidence_url")} AS host
        FROM contact_channels k JOIN companies c ON c.id = company_id),
    m AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(string_split({fold_sql("name")}, ' ')) AS w FROM b) WHERE length(w) >= 2 AND w NOT IN ({_STOP})),
    t AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(string_split({fold_sql("concat_ws(' ', title, snippet, host)")}, ' ')) AS w FROM b)),
    o AS (
        SELECT m.id, count(*) AS n, count(t.w) AS shared, bool_or(length(m.w) >= 4 AND contains(replace({fold_sql("host")}, ' ', ''), m.w)) OR contains(any_value(replace({fold_sql("host")}, ' ', '')), string_agg(m.w, '' ORDER BY m.w)) AS in_host
        FROM m JOIN b ON b.id = m.id LEFT JOIN t ON t.id = m.id AND t.w = m.w GROUP BY 1),
    s AS (
        SELECT company_id, url, CASE WHEN {_BLOCKED} THEN 0 ELSE least(0.62::DOUBLE * shared / n + CASE WHEN in_host THEN 0.2::DOUBLE ELSE 0 END
               + CASE WHEN place <> '' AND contains({fold_sql("concat_ws(' ', title, snippet)")}, place) THEN 0.12::DOUBLE ELSE 0 END
               + CASE WHEN regexp_matches({fold_sql("coalesce(title, '')")}, 'kontakt|oficjalna|official') THEN 0.04::DOUBLE ELSE 0 END, 1) END AS score
        FROM b JOIN o USING (id) WHERE host IS NOT NULL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, url) AS rank FROM s WHERE score >= 0.45) WHERE rank <= 3"""
SQL = {"websites_ranked": _RANKED, "stream_run_windows": RELATIONAL_SQL["run_windows"], "stream_jobs_current": RELATIONAL_SQL["jobs_current_view"]}
