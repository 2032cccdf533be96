"""Ordered reports and the frames of the dataset bundle, each with its SQL.

A report is the first `TOP` rows of an order whose ties end with an identifier: rows are sorted and cut within their
tasks, so only `TOP` rows a task meet, and the rank is given to those. Frames are whole tables joined to their companies;
what belongs to a company is aggregated before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.operators import state
from vacantia.plans.relational_queries import SQL as RELATIONAL_SQL
from vacantia.plans.relational_queries import identifier_conflicts
from vacantia.plans.tables import table

#: Rows of a report.
TOP = 100


def ranked(df: DataFrame, *order: Column, most: int = TOP) -> DataFrame:
    """The first `most` rows in the order, with their rank."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _number(c: str) -> Column:
    """A double without NaN."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _job_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "job_postings").groupBy("company_id").agg(F.count("*").alias("jobs"))


def companies_ranked(spark, sf):
    """Companies with the most postings, then by name."""
    c = table(spark, sf, "companies").select(F.col("id").alias("company_id"), "canonical_name", "city")
    return ranked(c.join(_job_counts(spark, sf), "company_id", "left").na.fill(0, ["jobs"]), F.col("jobs").desc(), F.col("canonical_name").asc_nulls_last(), F.col("company_id").asc())


def pending_companies(spark, sf):
    """Companies still to be looked up: never enriched and surely identified; the most postings first, then the surest."""
    c = table(spark, sf, "companies").select(F.col("id").alias("company_id"), "canonical_name", "enriched_at", _number("identity_confidence").alias("confidence")).filter("enriched_at is null and confidence >= 0.7")
    out = c.drop("enriched_at").join(_job_counts(spark, sf), "company_id", "left").na.fill(0, ["jobs"])
    return ranked(out, F.col("jobs").desc(), F.col("confidence").desc(), F.col("company_id").asc())


def green_ranked(spark, sf):
    """The surest green channels, then by name of the company."""
    k = table(spark, sf, "contact_channels").filter("decision = 'green'").select(F.col("id").alias("channel_id"), "company_id", "kind", "value", _number("confidence").alias("confidence"))
    c = table(spark, sf, "companies").select(F.col("id").alias("company_id"), "canonical_name")
    return ranked(k.join(c, "company_id"), F.col("confidence").desc_nulls_last(), F.col("canonical_name").asc_nulls_last(), F.col("channel_id").asc())


def conflicts_ranked(spark, sf):
    """Identifiers of several companies: the surest first, then those of most companies."""
    c = identifier_conflicts(spark, sf)
    return ranked(c, F.col("max_confidence").desc_nulls_last(), F.col("company_count").desc(), F.col("kind").asc(), F.col("value").asc())


def contact_template(spark, sf):
    """Channels to be labelled: green, review, others; the surest first; the columns of the truth are blank."""
    order = F.when(F.col("decision") == "green", 0).when(F.col("decision") == "review", 1).otherwise(2)
    k = table(spark, sf, "contact_channels").select(F.col("id").alias("channel_id"), "company_id", "kind", "value", "decision", _number("confidence").alias("confidence"), F.lit("").alias("truth_decision"), F.lit("").alias("truth_notes"))
    return ranked(k, order.asc(), F.col("confidence").desc_nulls_last(), F.col("channel_id").asc())


def runs_newest(spark, sf):
    """The newest runs with how long they took; unfinished ones have no duration."""
    r = table(spark, sf, "source_runs").select("id", "source", "status", "jobs_seen", (F.unix_micros("finished_at") - F.unix_micros("started_at")).alias("took_us"))
    return ranked(r, F.col("id").desc())


def sample_order(spark, sf):
    """Companies in the order of a seeded digest: the same sample whatever the order of the table."""
    digest = F.sha2(F.concat_ws("\u001f", F.lit("seed"), F.lit("final"), F.col("company_key")), 256)
    return ranked(table(spark, sf, "companies").select("company_key", digest.alias("digest")), F.col("digest").asc(), F.col("company_key").asc())


def first_unlabelled(spark, sf):
    """The first channel of each kind, in the order of the table, that has no decision."""
    k = table(spark, sf, "contact_channels").filter("decision is null or trim(decision) = '' or decision = 'review'")
    return k.groupBy("kind").agg(F.min("id").alias("channel_id"), F.count("*").alias("left"))


def _company_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "companies").select(F.col("id").alias("company_id"), "company_key", "canonical_name")


def export_companies(spark, sf):
    """Companies with their spellings and places in order, and counts of what belongs to them."""
    aliases = table(spark, sf, "company_aliases").groupBy("company_id").agg(F.concat_ws(" | ", F.array_sort(F.collect_set("alias"))).alias("aliases"))
    jobs = table(spark, sf, "job_postings").groupBy("company_id").agg(F.count("*").alias("jobs"), F.count_distinct("source").alias("sources"), F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"))
    ids = table(spark, sf, "company_identifier_observations").groupBy("company_id").agg(F.count_distinct(F.lower("kind")).alias("identifier_kinds"))
    contacts = table(spark, sf, "contact_channels").groupBy("company_id").agg(F.count("*").alias("channels"), F.count_if(F.col("decision") == "green").alias("green"))
    c = table(spark, sf, "companies").select(F.col("id").alias("company_id"), "company_key", "canonical_name", "normalized_name", "city", "identity_source", _number("identity_confidence").alias("identity_confidence"), "website_url")
    out = c.join(aliases, "company_id", "left").join(jobs, "company_id", "left").join(ids, "company_id", "left").join(contacts, "company_id", "left")
    out = out.na.fill(0, ["jobs", "sources", "identifier_kinds", "channels", "green"]).withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})
    return out.withColumn("aliases", F.coalesce("aliases", F.lit("")))


def export_jobs(spark, sf):
    p = table(spark, sf, "job_postings").select("id", "source", "source_id", "url", "title", "company_id", "company_name_raw", "company_resolution_method", "city", "published_at", F.unix_micros("last_seen_at").alias("last_seen_us"))
    return p.join(_company_key(spark, sf), "company_id", "left")


def export_contacts(spark, sf):
    """Channels with their company and their latest snapshot."""
    s = state.latest(table(spark, sf, "contact_evidence_snapshots").select("contact_channel_id", "id", "content_sha256", F.unix_micros("captured_at").alias("captured_us")), ["contact_channel_id"], [F.col("id").desc()]).drop("rank")
    k = table(spark, sf, "contact_channels").select(F.col("id").alias("channel_id"), "company_id", "kind", "value", "purpose", "decision", _number("confidence").alias("confidence"), "evidence_url")
    s = s.select(F.col("contact_channel_id").alias("channel_id"), F.col("id").alias("snapshot_id"), "content_sha256", "captured_us")
    return k.join(_company_key(spark, sf), "company_id").join(s, "channel_id", "left")


def export_identifiers(spark, sf):
    o = table(spark, sf, "company_identifier_observations").select("id", "company_id", "kind", "value", "job_source", "evidence_source", _number("confidence").alias("confidence"), "observation_count", F.unix_micros("first_seen_at").alias("first_seen_us"))
    return o.join(_company_key(spark, sf), "company_id")


def export_evidence(spark, sf):
    """Snapshots with their channel and company: three tables, none multiplied."""
    s = table(spark, sf, "contact_evidence_snapshots").select("id", "contact_channel_id", "company_id", "evidence_url", "evidence_signal", "content_sha256", F.length("evidence_text").alias("characters"))
    k = table(spark, sf, "contact_channels").select(F.col("id").alias("contact_channel_id"), "kind", "value", "decision")
    return s.join(k, "contact_channel_id").join(_company_key(spark, sf), "company_id")


def export_runs(spark, sf):
    """Runs with the label of their portal; runs of unknown sources are kept."""
    r = table(spark, sf, "source_runs").select("id", "source", "status", "pages_requested", "pages_processed", "jobs_seen", "jobs_inserted", "jobs_updated", "companies_created", "error_type", F.substring("error_message", 1, 1000).alias("error_message"))
    return r.join(table(spark, sf, "portals").select("source", "label", "portal_kind"), "source", "left")


def source_cursors(spark, sf):
    """Where each source goes on: the cursor after its last successful run, and its failures since."""
    r = table(spark, sf, "source_runs")
    last = r.filter("status = 'success'").groupBy("source").agg(F.max("id").alias("last_id"), F.max_by("cursor_after", "id").alias("cursor"))
    out = r.join(last, "source", "left").groupBy("source").agg(F.max("last_id").alias("last_id"), F.max("cursor").alias("cursor"), F.count_if((F.col("status") != "success") & (F.col("id") > F.coalesce("last_id", F.lit(-1)))).alias("failures_since"))
    return out


def run_totals(spark, sf):
    """What all runs did together."""
    r = table(spark, sf, "source_runs")
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("pages_requested", "pages_processed", "jobs_seen", "jobs_inserted", "jobs_updated", "companies_created")]
    return r.agg(F.count("*").alias("runs"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"), F.count("error_type").alias("errors"), *sums)


def corpus_counts(spark, sf):
    """Counts over all tables, one aggregate each."""
    t = lambda n: table(spark, sf, n)
    parts = [
        t("companies").agg(F.count("*").alias("companies"), F.count("website_url").alias("with_website"), F.count("enriched_at").alias("enriched"), F.count_if(_number("identity_confidence") >= 0.8).alias("sure"), F.count("city").alias("with_city")),
        t("company_aliases").agg(F.count("*").alias("aliases"), F.count_distinct("company_id").alias("companies_with_aliases")),
        t("job_postings").agg(F.count("*").alias("postings"), F.count_distinct("source").alias("sources"), F.count("company_id").alias("linked_postings"), F.count_if(F.trim("description") != "").alias("with_description")),
        t("job_posting_observations").agg(F.count("*").alias("observations"), F.count_distinct("source", "source_id").alias("observed_keys")),
        t("company_identifier_observations").agg(F.count("*").alias("identifier_rows"), F.count_distinct("company_id").alias("identified_companies")),
        t("contact_channels").agg(F.count("*").alias("channels"), F.count_if(F.col("decision") == "green").alias("green"), F.count_if(F.col("decision") == "review").alias("review"), F.count_distinct("company_id").alias("reachable_companies")),
        t("contact_evidence_snapshots").agg(F.count("*").alias("snapshots"), F.count_distinct("content_sha256").alias("different_snapshots")),
        t("source_runs").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successful_runs")),
    ]
    return _beside(parts)


def _beside(rows: list[DataFrame]) -> DataFrame:
    """Tables of one row each beside one another, joined on a constant."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def website_origins(spark, sf):
    """Companies by where their identity comes from, and how many of them have a sure website."""
    source = F.coalesce(F.lower(F.trim("identity_source")), F.lit("unknown"))
    return table(spark, sf, "companies").groupBy(source.alias("origin")).agg(F.count("*").alias("companies"), F.count_if(F.col("website_url").isNotNull() & (_number("website_confidence") >= 0.8)).alias("sure_websites"))


def score_bands(spark, sf):
    """Companies by confidence in bands of a quarter; bands without any are 0."""
    bands = spark.range(4).select(F.col("id").cast("int").alias("band"))
    c = table(spark, sf, "companies").select(F.least(F.floor(_number("identity_confidence") * 4), F.lit(3)).cast("int").alias("band"), _number("identity_confidence").alias("x")).filter("x between 0 and 1")
    return bands.join(F.broadcast(c.groupBy("band").agg(F.count("*").alias("companies"))), "band", "left").na.fill(0, ["companies"])


QUERIES = {
    f.__name__: f
    for f in (
        companies_ranked, pending_companies, green_ranked, conflicts_ranked, contact_template, runs_newest, sample_order, first_unlabelled, export_companies, export_jobs, export_contacts, export_identifiers, export_evidence, export_runs,
        source_cursors, run_totals, corpus_counts, website_origins, score_bands,
    )
}


def _top(select: str, order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({select}) ORDER BY {order} LIMIT {TOP}"


_JOBS = "LEFT JOIN (SELECT company_id, count(*) AS n FROM job_postings GROUP BY 1) j ON j.company_id = c.id"
_KEY = "JOIN (SELECT id AS company_id, company_key, canonical_name FROM companies) c USING (company_id)"


def _plain(c: str, alias: str | None = None) -> str:
    return f"CASE WHEN {c}::VARCHAR NOT IN ('nan', '-nan') THEN {c} END AS {alias or c.split('.')[-1]}"


SQL = {
    "companies_ranked": _top(f"SELECT c.id AS company_id, canonical_name, city, coalesce(n, 0) AS jobs FROM companies c {_JOBS}", "jobs DESC, canonical_name ASC NULLS LAST, company_id"),
    "pending_companies": _top(f"SELECT c.id AS company_id, canonical_name, identity_confidence AS confidence, coalesce(n, 0) AS jobs FROM companies c {_JOBS} WHERE enriched_at IS NULL AND NOT isnan(identity_confidence) AND identity_confidence >= 0.7", "jobs DESC, confidence DESC, company_id"),
    "green_ranked": _top(f"SELECT k.id AS channel_id, k.company_id, kind, value, {_plain('k.confidence')}, canonical_name FROM contact_channels k JOIN companies c ON c.id = k.company_id WHERE decision = 'green'", "confidence DESC NULLS LAST, canonical_name ASC NULLS LAST, channel_id"),
    "conflicts_ranked": _top(RELATIONAL_SQL["identifier_conflicts"], "max_confidence DESC NULLS LAST, company_count DESC, kind, value"),
    "contact_template": _top(f"SELECT id AS channel_id, company_id, kind, value, decision, {_plain('confidence')}, '' AS truth_decision, '' AS truth_notes FROM contact_channels", "CASE decision WHEN 'green' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, confidence DESC NULLS LAST, channel_id"),
    "runs_newest": _top("SELECT id, source, status, jobs_seen, epoch_us(finished_at) - epoch_us(started_at) AS took_us FROM source_runs", "id DESC"),
    "sample_order": _top("SELECT company_key, sha256('seed' || chr(31) || 'final' || chr(31) || company_key) AS digest FROM companies", "digest, company_key"),
    "first_unlabelled": "SELECT kind, min(id) AS channel_id, count(*) AS \"left\" FROM contact_channels WHERE decision IS NULL OR trim(decision) = '' OR decision = 'review' GROUP BY 1",
    "export_companies": f"""
        SELECT c.id AS company_id, company_key, canonical_name, normalized_name, city, identity_source, {_plain('identity_confidence')}, website_url, coalesce(a.s, '') AS aliases, coalesce(j.n, 0) AS jobs, coalesce(j.s, 0) AS sources,
               epoch_us(j.f) AS first_seen, epoch_us(j.l) AS last_seen, coalesce(i.n, 0) AS identifier_kinds, coalesce(k.n, 0) AS channels, coalesce(k.g, 0) AS green
        FROM companies c LEFT JOIN (SELECT company_id, string_agg(DISTINCT alias, ' | ' ORDER BY alias) AS s FROM company_aliases GROUP BY 1) a ON a.company_id = c.id
        LEFT JOIN (SELECT company_id, count(*) AS n, count(DISTINCT source) AS s, min(first_seen_at) AS f, max(last_seen_at) AS l FROM job_postings GROUP BY 1) j ON j.company_id = c.id
        LEFT JOIN (SELECT company_id, count(DISTINCT lower(kind)) AS n FROM company_identifier_observations GROUP BY 1) i ON i.company_id = c.id
        LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (decision = 'green') AS g FROM contact_channels GROUP BY 1) k ON k.company_id = c.id""",
    "export_jobs": f"SELECT id, source, source_id, url, title, company_id, company_name_raw, company_resolution_method, city, published_at, epoch_us(last_seen_at) AS last_seen_us, company_key, canonical_name FROM job_postings LEFT {_KEY}",
    "export_contacts": f"""
        SELECT k.id AS channel_id, k.company_id, k.kind, k.value, purpose, decision, {_plain('k.confidence')}, k.evidence_url, company_key, canonical_name, s.id AS snapshot_id, s.content_sha256, epoch_us(s.captured_at) AS captured_us
        FROM contact_channels k {_KEY} LEFT JOIN (SELECT * FROM contact_evidence_snapshots WHERE id IN (SELECT max(id) FROM contact_evidence_snapshots GROUP BY contact_channel_id)) s ON s.contact_channel_id = k.id""",
    "export_identifiers": f"SELECT id, company_id, kind, value, job_source, evidence_source, {_plain('confidence')}, observation_count, epoch_us(first_seen_at) AS first_seen_us, company_key, canonical_name FROM company_identifier_observations {_KEY}",
    "export_evidence": f"SELECT s.id, contact_channel_id, s.company_id, s.evidence_url, s.evidence_signal, content_sha256, length(evidence_text) AS characters, k.kind, k.value, k.decision, company_key, canonical_name FROM contact_evidence_snapshots s JOIN contact_channels k ON k.id = s.contact_channel_id JOIN (SELECT id AS company_id, company_key, canonical_name FROM companies) c ON c.company_id = s.company_id",
    "export_runs": "SELECT r.id, source, status, pages_requested, pages_processed, jobs_seen, jobs_inserted, jobs_updated, companies_created, error_type, left(error_message, 1000) AS error_message, label, portal_kind FROM source_runs r LEFT JOIN portals USING (source)",
    "source_cursors": """
        WITH l AS (SELECT source, max(id) AS last_id FROM source_runs WHERE status = 'success' GROUP BY 1)
        SELECT r.source, l.last_id, any_value(s.cursor_after) AS cursor, count(*) FILTER (r.status <> 'success' AND r.id > coalesce(l.last_id, -1)) AS failures_since
        FROM source_runs r LEFT JOIN l ON l.source = r.source LEFT JOIN source_runs s ON s.id = l.last_id GROUP BY 1, 2""",
    "run_totals": "SELECT count(*) AS runs, count(*) FILTER (finished_at IS NULL) AS unfinished, count(error_type) AS errors, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("pages_requested", "pages_processed", "jobs_seen", "jobs_inserted", "jobs_updated", "companies_created")) + " FROM source_runs",
    "corpus_counts": """
        SELECT * FROM (SELECT count(*) AS companies, count(website_url) AS with_website, count(enriched_at) AS enriched, count(*) FILTER (NOT isnan(identity_confidence) AND identity_confidence >= 0.8) AS sure, count(city) AS with_city FROM companies),
            (SELECT count(*) AS aliases, count(DISTINCT company_id) AS companies_with_aliases FROM company_aliases),
            (SELECT count(*) AS postings, count(DISTINCT source) AS sources, count(company_id) AS linked_postings, count(*) FILTER (trim(description) <> '') AS with_description FROM job_postings),
            (SELECT count(*) AS observations FROM job_posting_observations), (SELECT count(*) AS observed_keys FROM (SELECT DISTINCT source, source_id FROM job_posting_observations WHERE source IS NOT NULL AND source_id IS NOT NULL)),
            (SELECT count(*) AS identifier_rows, count(DISTINCT company_id) AS identified_companies FROM company_identifier_observations),
            (SELECT count(*) AS channels, count(*) FILTER (decision = 'green') AS green, count(*) FILTER (decision = 'review') AS review, count(DISTINCT company_id) AS reachable_companies FROM contact_channels),
            (SELECT count(*) AS snapshots, count(DISTINCT content_sha256) AS different_snapshots FROM contact_evidence_snapshots), (SELECT count(*) AS runs, count(*) FILTER (status = 'success') AS successful_runs FROM source_runs)""",
    "website_origins": "SELECT coalesce(lower(trim(identity_source)), 'unknown') AS origin, count(*) AS companies, count(*) FILTER (website_url IS NOT NULL AND NOT isnan(website_confidence) AND website_confidence >= 0.8) AS sure_websites FROM companies GROUP BY 1",
    "score_bands": "SELECT b.band::INTEGER AS band, count(c.x) AS companies FROM range(4) b(band) LEFT JOIN (SELECT identity_confidence AS x FROM companies WHERE NOT isnan(identity_confidence) AND identity_confidence BETWEEN 0 AND 1) c ON least(floor(c.x * 4), 3) = b.band GROUP BY 1",
}
