"""Samples for labelling, their strata, and views that feed them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.plans.tables import table

#: Rows of a sample, and how many rows of it make room for one pair of anchors.
LIMIT, PER_PAIR = 200, 8
SEED = "seed"


def digest(space: str, *parts: str | Column) -> Column:
    """A seeded order that is the same whatever the order of the rows."""
    return F.sha2(F.concat_ws("\u001f", F.lit(SEED), F.lit(space), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "job_postings").select("id", "company_id").filter("company_id is not null")


def pair_anchors(spark, sf):
    """Two postings of each of some companies that have several: pairs whose truth is likely one company.

    Companies are drawn by their digest, a bounded number of them; a company's two postings are its least digests, found by
    an aggregate, so a company with a third of all postings is no single sort.
    """
    p = _postings(spark, sf).withColumn("d", digest("row", "id"))
    # the two least: the least over all, and the least of the others
    first = p.groupBy("company_id").agg(F.count("*").alias("n"), F.min(F.struct("d", "id")).alias("one")).filter("n >= 2").withColumn("c", digest("cluster", "company_id"))
    drawn = first.orderBy("c", "company_id").limit(LIMIT // PER_PAIR)
    rest = p.join(drawn.select("company_id", F.col("one.id").alias("one_id")), "company_id").filter("id <> one_id")
    second = rest.groupBy("company_id").agg(F.min(F.struct("d", "id")).alias("two"))
    return drawn.select("company_id", F.col("one.id").alias("id")).unionByName(second.select("company_id", F.col("two.id").alias("id")))


def sample_with_anchors(spark, sf):
    """The anchors and, of all other postings, the first by digest, `LIMIT` together."""
    p = _postings(spark, sf)
    anchors = pair_anchors(spark, sf).select("id", "company_id", F.lit(True).alias("anchor"))
    others = p.join(anchors.select("id"), "id", "left_anti").withColumn("d", digest("rest", "id")).orderBy("d", "id").limit(LIMIT).withColumn("anchor", F.lit(False))
    both = anchors.withColumn("d", F.lit("")).unionByName(others.select("id", "company_id", "anchor", "d"))
    # at most LIMIT rows and the anchors
    return both.withColumn("_at", F.row_number().over(Window.orderBy(F.col("anchor").desc(), "d", "id"))).filter(F.col("_at") <= LIMIT).select("id", "company_id", "anchor")


def _band(c: str) -> Column:
    x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return F.when(x < 0.5, "low").when(x < 0.8, "medium").when(x < 0.95, "high").when(x.isNotNull(), "sure").otherwise("unknown")


def contact_strata(spark, sf):
    """Channels by kind, decision and band of confidence."""
    k = table(spark, sf, "contact_channels")
    return k.groupBy(F.concat_ws("|", F.coalesce("kind", F.lit("unknown")), F.coalesce("decision", F.lit("unknown")), _band("confidence")).alias("stratum")).agg(F.count("*").alias("channels"))


def website_strata(spark, sf):
    """Companies by source of identity, whether they have a website, and its band of confidence."""
    c = table(spark, sf, "companies")
    return c.groupBy(F.concat_ws("|", F.coalesce("identity_source", F.lit("unknown")), F.when(F.coalesce(F.trim("website_url"), F.lit("")) != "", "website").otherwise("none"), _band("website_confidence")).alias("stratum")).agg(F.count("*").alias("companies"))


def best_by_value(spark, sf):
    """Of the channels of a company that say the same (kind and value, letter case aside) the surest, the first of equals."""
    k = table(spark, sf, "contact_channels").withColumn("v", F.lower("value"))
    best = k.groupBy("company_id", "kind", "v").agg(F.max_by(F.struct("id", "decision", "purpose"), F.struct(F.coalesce(F.nanvl("confidence", F.lit(-1.0)), F.lit(-1.0)), -F.col("id"))).alias("b"), F.count("*").alias("rows"))
    return best.select("company_id", "kind", F.col("v").alias("value"), F.col("b.id").alias("channel_id"), F.col("b.decision").alias("decision"), F.col("b.purpose").alias("purpose"), "rows")


def observations_linked(spark, sf):
    """By source, how many observations have a current posting of their key, and of how many companies; sightings are counted before the join."""
    o = table(spark, sf, "job_posting_observations").filter("source is not null and source_id is not null").groupBy("source", "source_id").agg(F.count("*").alias("n"))
    p = table(spark, sf, "job_postings").select("source", "source_id", "company_id")
    j = o.join(p.withColumn("known", F.lit(True)), ["source", "source_id"], "left")
    return j.groupBy("source").agg(F.sum("n").alias("observations"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("linked"), F.count_distinct("company_id").alias("companies"))


def snapshots_kept(spark, sf):
    """What insert-or-ignore keeps of the snapshots: the first of each channel and content, and how many it passes over."""
    s = table(spark, sf, "contact_evidence_snapshots")
    return s.groupBy("contact_channel_id", "content_sha256").agg(F.min("id").alias("snapshot_id"), (F.count("*") - 1).alias("ignored"), F.max_by("evidence_url", "id").alias("last_url"))


def source_report(spark, sf):
    """Every portal beside its runs, postings and companies; each side is aggregated before the join."""
    d = table(spark, sf, "portals").select("source", "label", "portal_kind")
    r = table(spark, sf, "source_runs").groupBy("source").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successes"), F.max("id").alias("last_run"), F.max_by("status", "id").alias("last_status"))
    p = table(spark, sf, "job_postings").groupBy("source").agg(F.count("*").alias("postings"), F.count_distinct("company_id").alias("companies"), F.count_if(F.trim("description") != "").alias("with_description"), F.avg(F.nanvl("company_resolution_confidence", F.lit(None).cast("double"))).alias("mean_confidence"))
    state = F.when(F.col("runs").isNull(), "unexercised").when(F.col("last_status") == "success", "healthy").otherwise("failing")
    out = d.join(r, "source", "left").join(p, "source", "left").withColumn("state", state)
    return out.na.fill(0, ["runs", "successes", "postings", "companies", "with_description"])


QUERIES = {f.__name__: f for f in (pair_anchors, sample_with_anchors, contact_strata, website_strata, best_by_value, observations_linked, snapshots_kept, source_report)}

_PLAIN = "{0}::VARCHAR NOT IN ('nan', '-nan')"
_BAND = "CASE WHEN {0} IS NULL OR {0}::VARCHAR IN ('nan', '-nan') THEN 'unknown' WHEN {0} < 0.5 THEN 'low' WHEN {0} < 0.8 THEN 'medium' WHEN {0} < 0.95 THEN 'high' ELSE 'sure' END"
_DIGEST = f"sha256('{SEED}' || chr(31) || '{{0}}' || chr(31) || {{1}}::VARCHAR)"
_ANCHORS = f"""
    p AS (SELECT id, company_id, {_DIGEST.format('row', 'id')} AS d FROM job_postings WHERE company_id IS NOT NULL),
    drawn AS (SELECT company_id FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY {_DIGEST.format('cluster', 'company_id')}, company_id LIMIT {LIMIT // PER_PAIR}),
    anchors AS (SELECT id, company_id FROM (SELECT id, company_id, row_number() OVER (PARTITION BY company_id ORDER BY d, id) AS k FROM p JOIN drawn USING (company_id)) WHERE k <= 2)"""

SQL = {
    "pair_anchors": f"WITH {_ANCHORS} SELECT company_id, id FROM anchors",
    "sample_with_anchors": f"""
        WITH {_ANCHORS},
        others AS (SELECT id, company_id, {_DIGEST.format('rest', 'id')} AS e FROM p WHERE id NOT IN (SELECT id FROM anchors)),
        both_ AS (SELECT id, company_id, true AS anchor, '' AS e FROM anchors UNION ALL SELECT id, company_id, false, e FROM others)
        SELECT id, company_id, anchor FROM both_ ORDER BY anchor DESC, e, id LIMIT {LIMIT}""",
    "contact_strata": f"SELECT coalesce(kind, 'unknown') || '|' || coalesce(decision, 'unknown') || '|' || {_BAND.format('confidence')} AS stratum, count(*) AS channels FROM contact_channels GROUP BY 1",
    "website_strata": f"SELECT coalesce(identity_source, 'unknown') || '|' || CASE WHEN coalesce(trim(website_url), '') <> '' THEN 'website' ELSE 'none' END || '|' || {_BAND.format('website_confidence')} AS stratum, count(*) AS companies FROM companies GROUP BY 1",
    "best_by_value": f"""
        SELECT company_id, kind, v AS value, id AS channel_id, decision, purpose, n AS rows FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id, kind, v ORDER BY CASE WHEN {_PLAIN.format('confidence')} THEN confidence ELSE -1 END DESC, id) AS k, count(*) OVER (PARTITION BY company_id, kind, v) AS n
            FROM (SELECT *, lower(value) AS v FROM contact_channels)) WHERE k = 1""",
    "observations_linked": """
        SELECT o.source, count(*) AS observations, count(p.id) AS linked, count(DISTINCT p.company_id) AS companies
        FROM job_posting_observations o LEFT JOIN job_postings p ON p.source = o.source AND p.source_id = o.source_id WHERE o.source IS NOT NULL AND o.source_id IS NOT NULL GROUP BY 1""",
    "snapshots_kept": "SELECT contact_channel_id, content_sha256, min(id) AS snapshot_id, count(*) - 1 AS ignored, arg_max(evidence_url, id) AS last_url FROM contact_evidence_snapshots GROUP BY 1, 2",
    "source_report": f"""
        SELECT d.source, label, portal_kind, coalesce(runs, 0) AS runs, coalesce(successes, 0) AS successes, last_run, last_status, coalesce(postings, 0) AS postings, coalesce(companies, 0) AS companies, coalesce(with_description, 0) AS with_description, mean_confidence,
               CASE WHEN runs IS NULL THEN 'unexercised' WHEN last_status = 'success' THEN 'healthy' ELSE 'failing' END AS state
        FROM portals d LEFT JOIN (SELECT source, count(*) AS runs, count(*) FILTER (status = 'success') AS successes, max(id) AS last_run, arg_max(status, id) AS last_status FROM source_runs GROUP BY 1) r ON r.source = d.source
        LEFT JOIN (SELECT source, count(*) AS postings, count(DISTINCT company_id) AS companies, count(*) FILTER (trim(description) <> '') AS with_description, avg(company_resolution_confidence) FILTER ({_PLAIN.format('company_resolution_confidence')}) AS mean_confidence FROM job_postings GROUP BY 1) p ON p.source = d.source""",
}
