"""Queries over the current state, the logs and the sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.analytics import overlap, sources
from vacantia.evaluation import metrics, sampling
from vacantia.functions import identifiers, urls
from vacantia.functions.text import LEGAL_PATTERN, folded, without_legal_forms
from vacantia.operators import state
from vacantia.resolve import review
from vacantia.plans.tables import table

_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(replace(lower(trim({0})), 'ł', 'l')), '\\p{{M}}+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_HOST = "nullif(regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.|\\.$', '', 'g'), '')"


def fold_sql(column: str) -> str:
    return _FOLD.format(column)


def host_sql(column: str) -> str:
    return _HOST.format(column)


def legal_sql(expression: str, rounds: int = 7) -> str:
    for _ in range(rounds):
        expression = f"trim(regexp_replace(regexp_replace({expression}, '{LEGAL_PATTERN}', ' ', 'g'), '\\s+', ' ', 'g'))"
    return expression


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


def jobs_current_view(spark, sf):
    return state.current_postings(table(spark, sf, "job_posting_observations"))


def jobs_upsert_stats(spark, sf):
    return state.upsert_stats(table(spark, sf, "job_posting_observations"))


def source_job_counts(spark, sf):
    return table(spark, sf, "job_postings").groupBy("source").agg(F.count("*").alias("jobs"), F.count_distinct("company_id").alias("companies"))


def company_aliases_accumulated(spark, sf):
    return state.accumulated_aliases(table(spark, sf, "job_postings"))


def company_locations_accumulated(spark, sf):
    return state.accumulated_locations(table(spark, sf, "job_postings"), folded(F.col("city")))


def company_list(spark, sf):
    """Companies with counts of their postings, sources, channels and all their spellings; children aggregated first."""
    c, p, k, a = _t(spark, sf, "companies", "job_postings", "contact_channels", "company_aliases")
    jobs = p.groupBy("company_id").agg(F.count("*").alias("jobs"), F.count_distinct("source").alias("sources"))
    green = k.groupBy("company_id").agg(F.count_if(F.col("decision") == "green").alias("green"), F.count("*").alias("channels"))
    spelt = a.groupBy("company_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("normalized_alias"))).alias("spellings"))
    base = c.select(F.col("id").alias("company_id"), "company_key", "canonical_name", "normalized_city")
    out = base.join(jobs, "company_id", "left").join(green, "company_id", "left").join(spelt, "company_id", "left")
    return out.na.fill(0, ["jobs", "sources", "green", "channels"])


def green_channels(spark, sf):
    k, c = _t(spark, sf, "contact_channels", "companies")
    return k.filter("decision = 'green'").join(c.select(F.col("id").alias("company_id"), "canonical_name", "city"), "company_id").select("company_id", "canonical_name", "city", "kind", "value", "purpose", "confidence", "evidence_url")


def best_channel_per_kind(spark, sf):
    """Per company and kind the surest channel, the first of equals."""
    k = table(spark, sf, "contact_channels")
    best = k.groupBy("company_id", "kind").agg(F.max_by(F.struct("id", "value", "decision", "confidence"), F.struct("confidence", (-F.col("id")).alias("i"))).alias("b"), F.count("*").alias("channels"))
    return best.select("company_id", "kind", F.col("b.id").alias("channel_id"), F.col("b.value").alias("value"), F.col("b.decision").alias("decision"), "channels")


def top3_evidence_hosts(spark, sf):
    k = table(spark, sf, "contact_channels").select("company_id", urls.host_of(F.col("evidence_url")).alias("host"), "confidence").filter("host is not null")
    g = k.groupBy("company_id", "host").agg(F.max("confidence").alias("confidence"), F.count("*").alias("observations"))
    return state.latest(g, ["company_id"], [F.col("confidence").desc(), F.col("observations").desc(), F.col("host").asc()], 3)


def _identifiers(spark, sf):
    kind = identifiers.identifier_kind(F.col("kind"))
    return state.accumulated_identifiers(table(spark, sf, "company_identifier_observations"), kind, identifiers.identifier_value(kind, F.col("value")))


def identifier_current(spark, sf):
    return _identifiers(spark, sf)


def identifier_conflicts(spark, sf):
    return state.identifier_conflicts(_identifiers(spark, sf))


def identifier_conflicting_rows(spark, sf):
    return state.conflicting_rows(_identifiers(spark, sf)).select("kind", "value", "company_id", "confidence")


def identifier_audit(spark, sf):
    """How many observations of each kind are valid, strong, or neither."""
    kind = identifiers.identifier_kind(F.col("kind"))
    o = table(spark, sf, "company_identifier_observations").select(kind.alias("k"), identifiers.identifier_value(kind, F.col("value")).alias("v"), "confidence")
    return o.groupBy(F.col("k").alias("kind")).agg(F.count("*").alias("observations"), F.count("v").alias("valid"), F.count_if(F.col("v").isNotNull() & identifiers.is_strong(F.col("k"), F.col("confidence"))).alias("strong"))


def _fingerprints(spark, sf):
    return overlap.source_fingerprints(table(spark, sf, "job_postings"))


def overlap_by_source(spark, sf):
    return overlap.by_source(_fingerprints(spark, sf))


def overlap_pairwise(spark, sf):
    return overlap.pairwise(_fingerprints(spark, sf))


def overlap_global(spark, sf):
    per = _fingerprints(spark, sf).groupBy("fp").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("fingerprints"), F.count_if(F.col("n") > 1).alias("shared"))


def source_identity_metrics(spark, sf):
    return sources.identity_metrics(table(spark, sf, "job_postings"))


def resolution_method_stats(spark, sf):
    return sources.resolution_methods(table(spark, sf, "job_postings"))


def source_provenance_metrics(spark, sf):
    return sources.provenance(*_t(spark, sf, "company_identifier_observations", "job_postings"))


def source_run_metrics(spark, sf):
    return sources.run_metrics(table(spark, sf, "source_runs"))


def source_health(spark, sf):
    p, r = _t(spark, sf, "portals", "source_runs")
    return sources.health(p.select("source"), r)


def downstream_by_source(spark, sf):
    return sources.downstream(*_t(spark, sf, "job_postings", "companies", "contact_channels"))


def latest_snapshots(spark, sf):
    s = table(spark, sf, "contact_evidence_snapshots")
    return state.last_values(s, ["contact_channel_id"], F.col("id"), ["id", "company_id", "content_sha256", "captured_at"])


def evidence_changes(spark, sf):
    s = table(spark, sf, "contact_evidence_snapshots").select("id", "contact_channel_id", "content_sha256")
    return state.changes(s, "contact_channel_id", "content_sha256", ["id"])


def evidence_hash_check(spark, sf):
    """Whether each snapshot's stored hash is that of its text."""
    s = table(spark, sf, "contact_evidence_snapshots")
    return s.select("id", F.sha2(F.encode("evidence_text", "UTF-8"), 256).alias("sha256"), F.coalesce(F.sha2(F.encode("evidence_text", "UTF-8"), 256) == F.col("content_sha256"), F.lit(False)).alias("same"))


def attempts_first_accepted(spark, sf):
    """Channels of a company as attempts in the order of confidence, up to the first green one."""
    k = table(spark, sf, "contact_channels")
    from pyspark.sql import Window

    ranked = k.select("company_id", "id", (F.col("decision") == "green").alias("accepted"), F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("confidence").desc(), "id")).alias("rank"))
    return state.until_first_accepted(ranked, "company_id", "rank", "accepted")


def benchmark_counts(spark, sf):
    """The report's counts, one pass per table."""
    c, p, k, r = _t(spark, sf, "companies", "job_postings", "contact_channels", "source_runs")
    one = F.lit(1).alias("k")
    a = c.agg(F.count("*").alias("companies"), F.count("website_url").alias("with_website"), F.count("enriched_at").alias("enriched"), F.count_if(F.col("identity_confidence").between(0.95, 1)).alias("sure_identity")).select("*", one)
    b = p.agg(F.count("*").alias("postings"), F.count_distinct("source").alias("sources"), F.count_distinct("company_id").alias("companies_with_postings")).select("*", one)
    d = k.agg(F.count("*").alias("channels"), F.count_if(F.col("decision") == "green").alias("green"), F.count_if(F.col("decision") == "review").alias("review"), F.count_distinct(F.when(F.col("decision") == "green", F.col("company_id"))).alias("companies_with_green")).select("*", one)
    e = r.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed_runs")).select("*", one)
    return a.join(b, "k").join(d, "k").join(e, "k").drop("k")


def confidence_bands(spark, sf):
    """Companies by band of identity confidence; NULL, NaN and values outside 0..1 are unknown."""
    x = F.col("identity_confidence")
    band = F.when(~x.between(0, 1) | x.isNull(), "unknown").when(x < 0.5, "low").when(x < 0.8, "medium").when(x < 0.95, "high").otherwise("very_high")
    return table(spark, sf, "companies").groupBy(band.alias("band")).agg(F.count("*").alias("companies"))


def contact_confusion(spark, sf):
    """Decisions of channels against a truth made of their identifiers (every fifth differs)."""
    classes = ["green", "review", "ignore"]
    k = table(spark, sf, "contact_channels")
    truth = F.when(F.col("id") % 5 == 0, F.element_at(F.array(*map(F.lit, classes)), (F.col("id") % 3 + 1).cast("int"))).otherwise(F.col("decision"))
    return metrics.confusion(k, truth, F.col("decision"), classes)


def contact_metrics(spark, sf):
    return metrics.class_metrics(contact_confusion(spark, sf))


def website_eval(spark, sf):
    c = table(spark, sf, "companies")
    predicted = urls.host_of(F.col("website_url"))
    truth = F.when(F.col("id") % 10 == 0, F.lit(None).cast("string")).when(F.col("id") % 10 == 1, "other.example").otherwise(predicted)
    return metrics.domain_outcomes(c, truth, predicted)


def pairwise_resolution_eval(spark, sf):
    p = table(spark, sf, "job_postings")
    return metrics.pairwise(p, F.concat_ws("|", without_legal_forms(folded(F.col("company_name_raw"))), F.coalesce(folded(F.col("city")), F.lit(""))), F.col("company_id"))


def label_status(spark, sf):
    k = table(spark, sf, "contact_channels")
    label = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 13 == 0, metrics.EXCLUDED).otherwise(F.col("decision"))
    return metrics.label_status(k, label, ["green", "review", "ignore"])


def stratified_sample(spark, sf):
    p = table(spark, sf, "job_postings").select("id", "source", F.coalesce("company_resolution_method", F.lit("legacy")).alias("method"))
    return sampling.stratified_sample(p, F.col("id"), F.concat_ws("|", "source", "method"), 200, "seed").select("id", "source", "method")


def sample_allocation(spark, sf):
    p = table(spark, sf, "job_postings")
    return sampling.allocation(p.groupBy(F.concat_ws("|", "source", F.coalesce("company_resolution_method", F.lit("legacy"))).alias("stratum")).agg(F.count("*").alias("n")), 200, "seed")


def _firms(spark, sf):
    c = table(spark, sf, "companies").filter("normalized_name is not null")
    sure = [F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")).alias(y) for x, y in (("website_confidence", "website_confidence"), ("identity_confidence", "confidence"))]
    return c.select("id", F.col("normalized_name").alias("name"), F.col("normalized_city").alias("city"), "website_url", *sure)


def review_all_block_pairs(spark, sf):
    """Pairs of companies that share a word of 4 letters, first or last letters or a sure website, in any city."""
    return review.blocked_pairs(_firms(spark, sf))


def review_scored_pairs(spark, sf):
    """Those pairs that score high enough for a person to look at."""
    firms = _firms(spark, sf)
    return review.scored_pairs(firms, review.likely_pairs(firms))


def url_hosts(spark, sf):
    return table(spark, sf, "job_postings").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("postings"))


def emails_in_text(spark, sf):
    """Plain addresses in evidence texts, with how many snapshots hold them."""
    s = table(spark, sf, "contact_evidence_snapshots")
    found = s.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("evidence_text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), 0))).alias("email"))
    return found.groupBy("email").agg(F.count("*").alias("snapshots"))


def folded_names(spark, sf):
    return table(spark, sf, "job_postings").select("id", without_legal_forms(folded(F.col("company_name_raw"))).alias("name"), folded(F.col("city")).alias("city"))


def run_windows(spark, sf):
    """Runs per source and day, by event time."""
    return table(spark, sf, "source_runs").groupBy("source", F.window("started_at", "1 day").alias("w")).agg(F.count("*").alias("runs"), F.coalesce(F.sum("jobs_seen"), F.lit(0)).alias("jobs_seen")).select("source", F.unix_micros("w.start").alias("day_us"), "runs", "jobs_seen")


def leads(spark, sf):
    """One row per company with a green channel: the surest contact, all of its contacts in order, its posting count and identifiers by kind."""
    c, k, p = _t(spark, sf, "companies", "contact_channels", "job_postings")
    green = k.filter("decision = 'green'")
    rank = F.struct((-F.col("confidence")).alias("c"), "kind", "value")
    contacts = green.groupBy("company_id").agg(F.min(rank).alias("first"), F.array_sort(F.collect_list(rank)).alias("all"))
    jobs = p.groupBy("company_id").agg(F.count("*").alias("jobs"), F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources"))
    ids = _identifiers(spark, sf).filter(F.col("kind").isin("nip", "regon", "krs")).groupBy("company_id").pivot("kind", ["nip", "regon", "krs"]).agg(F.min("value"))
    out = contacts.join(c.select(F.col("id").alias("company_id"), "canonical_name", "city"), "company_id").join(jobs, "company_id", "left").join(ids, "company_id", "left")
    return out.select(
        "company_id", "canonical_name", "city", F.col("first.kind").alias("primary_kind"), F.col("first.value").alias("primary_value"), F.array_join(F.transform("all", lambda x: x["value"]), " | ").alias("contacts"),
        F.coalesce("jobs", F.lit(0)).alias("jobs"), "sources", "nip", "regon", "krs",
    )


def shared_contacts(spark, sf):
    """Contact values that several companies give, with the first and the number of them."""
    k = table(spark, sf, "contact_channels")
    g = k.groupBy("kind", F.lower("value").alias("value")).agg(F.count_distinct("company_id").alias("companies"), F.min("company_id").alias("first_company_id"))
    return g.filter("companies > 1")


QUERIES = {f.__name__: f for f in (
    jobs_current_view, jobs_upsert_stats, source_job_counts, company_aliases_accumulated, company_locations_accumulated, company_list, green_channels, best_channel_per_kind, top3_evidence_hosts,
    identifier_current, identifier_conflicts, identifier_conflicting_rows, identifier_audit, overlap_by_source, overlap_pairwise, overlap_global, source_identity_metrics, resolution_method_stats, source_provenance_metrics,
    source_run_metrics, source_health, downstream_by_source, latest_snapshots, evidence_changes, evidence_hash_check, attempts_first_accepted, benchmark_counts, confidence_bands, contact_confusion, contact_metrics, website_eval,
    leads, shared_contacts, pairwise_resolution_eval, label_status, stratified_sample, sample_allocation, review_all_block_pairs, review_scored_pairs, url_hosts, emails_in_text, folded_names, run_windows,
)}

_FP = f"""fps AS (SELECT DISTINCT lower(trim(source)) AS source, {legal_sql(fold_sql('company_name_raw'))} || '|' || {fold_sql('title')} || '|' || coalesce({fold_sql('city')}, '') AS fp
        FROM job_postings WHERE source IS NOT NULL AND {legal_sql(fold_sql('company_name_raw'))} <> '' AND {fold_sql('title')} <> '')"""
_ID = r"""ids AS (SELECT company_id, k AS kind, CASE WHEN k = 'nip' OR k = 'krs' THEN CASE WHEN length(d) = 10 THEN d END WHEN k = 'regon' THEN CASE WHEN length(d) IN (9, 14) THEN d END
        WHEN length(o) BETWEEN 2 AND 128 THEN o END AS value, confidence, observation_count, evidence_source, last_seen_at, id
        FROM (SELECT *, nullif(lower(trim(kind)), '') AS k, regexp_replace(value, '[^0-9]', '', 'g') AS d, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS o FROM company_identifier_observations)),
    cur AS (SELECT company_id, kind, value, max(confidence) AS confidence, CAST(sum(observation_count) AS BIGINT) AS observations, arg_max(evidence_source, (last_seen_at, id)) AS evidence_source
        FROM ids WHERE company_id IS NOT NULL AND kind IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"""
_CONFUSION = """cm AS (SELECT t.c AS truth, p.c AS predicted, count(k.id) AS n FROM (VALUES ('green'), ('review'), ('ignore')) t(c) CROSS JOIN (VALUES ('green'), ('review'), ('ignore')) p(c)
        LEFT JOIN contact_channels k ON k.decision = p.c AND t.c = CASE WHEN id % 5 = 0 THEN CASE id % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'review' ELSE 'ignore' END ELSE decision END GROUP BY ALL)"""
_STRATA = "strata AS (SELECT source || '|' || coalesce(company_resolution_method, 'legacy') AS stratum, count(*) AS n FROM job_postings GROUP BY 1)"
_TAKE = """a AS (SELECT *, sha256('seed' || chr(31) || 'stratum' || chr(31) || stratum) AS d, sum(n) OVER () AS all_n, count(*) OVER () AS k FROM strata),
    b AS (SELECT *, least(200, all_n) AS want, row_number() OVER (ORDER BY d) AS rank FROM a),
    c AS (SELECT *, CASE WHEN k <= want THEN 1 WHEN rank <= want THEN 1 ELSE 0 END AS base, greatest(want - k, 0) AS rest FROM b),
    e AS (SELECT *, n - base AS pool, sum(n - base) OVER () AS all_pool FROM c),
    f AS (SELECT *, CASE WHEN all_pool > 0 THEN (rest * pool) // all_pool ELSE 0 END AS share, CASE WHEN all_pool > 0 THEN (rest * pool) % all_pool ELSE 0 END AS left_over FROM e),
    g AS (SELECT *, rest - sum(share) OVER () AS missing, row_number() OVER (ORDER BY left_over DESC, d) AS turn FROM f),
    take AS (SELECT stratum, n, CAST(base + share + CASE WHEN turn <= missing THEN 1 ELSE 0 END AS BIGINT) AS take FROM g)"""
_RATIO = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE) ELSE 0.0 END"


def ratio_sql(n: str, d: str) -> str:
    return _RATIO.format(n, d)


SQL = {
    "jobs_current_view": """SELECT source, source_id, arg_max(id, (observed_at, id)) AS observation_id, s.url, s.title, s.company_name_raw, s.city, s.description, s.published_at, s.refreshed_at, min(first_seen_at) AS first_seen_at, min(last_seen_at) AS last_seen_at, min(n) AS sightings
        FROM (SELECT source, source_id, id, observed_at, {'url': url, 'title': title, 'company_name_raw': company_name_raw, 'city': city, 'description': description, 'published_at': published_at, 'refreshed_at': refreshed_at} AS s,
            min(observed_at) OVER w AS first_seen_at, max(observed_at) OVER w AS last_seen_at, count(*) OVER w AS n, row_number() OVER (PARTITION BY source, source_id ORDER BY observed_at DESC, id DESC) AS rn
            FROM job_posting_observations WHERE source IS NOT NULL AND source_id IS NOT NULL WINDOW w AS (PARTITION BY source, source_id)) WHERE rn = 1 GROUP BY ALL""",
    "jobs_upsert_stats": "SELECT source, count(*) AS seen, count(DISTINCT source_id) AS inserted, count(*) - count(DISTINCT source_id) AS updated FROM job_posting_observations WHERE source IS NOT NULL AND source_id IS NOT NULL GROUP BY 1",
    "source_job_counts": "SELECT source, count(*) AS jobs, count(DISTINCT company_id) AS companies FROM job_postings GROUP BY 1",
    "company_aliases_accumulated": "SELECT company_id, company_name_raw AS alias, max(company_name_confidence) AS confidence, arg_max(source, (company_name_confidence, id)) AS source, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM job_postings WHERE company_id IS NOT NULL AND company_name_raw IS NOT NULL GROUP BY 1, 2",
    "company_locations_accumulated": f"SELECT company_id, {fold_sql('city')} AS normalized_city, arg_min(city, (first_seen_at, id)) AS city, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM job_postings WHERE company_id IS NOT NULL AND {fold_sql('city')} <> '' GROUP BY 1, 2",
    "company_list": """SELECT c.id AS company_id, company_key, canonical_name, normalized_city, coalesce(j.jobs, 0) AS jobs, coalesce(j.sources, 0) AS sources, coalesce(g.green, 0) AS green, coalesce(g.channels, 0) AS channels, s.spellings FROM companies c
        LEFT JOIN (SELECT company_id, count(*) AS jobs, count(DISTINCT source) AS sources FROM job_postings GROUP BY 1) j ON j.company_id = c.id
        LEFT JOIN (SELECT company_id, count(*) FILTER (WHERE decision = 'green') AS green, count(*) AS channels FROM contact_channels GROUP BY 1) g ON g.company_id = c.id
        LEFT JOIN (SELECT company_id, string_agg(DISTINCT normalized_alias, ',' ORDER BY normalized_alias) AS spellings FROM company_aliases GROUP BY 1) s ON s.company_id = c.id""",
    "green_channels": "SELECT company_id, canonical_name, city, kind, value, purpose, confidence, evidence_url FROM contact_channels k JOIN companies c ON c.id = k.company_id WHERE decision = 'green'",
    "best_channel_per_kind": "SELECT company_id, kind, id AS channel_id, value, decision, n AS channels FROM (SELECT *, row_number() OVER (PARTITION BY company_id, kind ORDER BY confidence DESC, id) AS rn, count(*) OVER (PARTITION BY company_id, kind) AS n FROM contact_channels) WHERE rn = 1",
    "top3_evidence_hosts": f"SELECT company_id, host, confidence, observations FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY confidence DESC, observations DESC, host) AS rn FROM (SELECT company_id, {host_sql('evidence_url')} AS host, max(confidence) AS confidence, count(*) AS observations FROM contact_channels WHERE {host_sql('evidence_url')} IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 3",
    "identifier_current": f"WITH {_ID} SELECT * FROM cur",
    "identifier_conflicts": f"WITH {_ID} SELECT kind, value, count(DISTINCT company_id) AS company_count, max(confidence) AS max_confidence, min(company_id) AS first_company_id FROM cur GROUP BY 1, 2 HAVING count(DISTINCT company_id) > 1",
    "identifier_conflicting_rows": f"WITH {_ID} SELECT kind, value, company_id, confidence FROM cur a WHERE EXISTS (SELECT 1 FROM cur b WHERE b.kind = a.kind AND b.value = a.value AND b.company_id <> a.company_id)",
    "identifier_audit": f"WITH {_ID} SELECT kind, count(*) AS observations, count(value) AS valid, count(*) FILTER (WHERE value IS NOT NULL AND confidence >= 0.95 AND (kind IN ('nip', 'regon', 'krs') OR kind LIKE '%employer_profile')) AS strong FROM ids GROUP BY 1",
    "overlap_by_source": f"WITH {_FP}, per AS (SELECT fp, count(*) AS n FROM fps GROUP BY 1) SELECT source, count(*) AS fingerprints, count(*) FILTER (WHERE n = 1) AS exclusive, count(*) FILTER (WHERE n > 1) AS shared, CAST(count(*) FILTER (WHERE n = 1) AS DOUBLE) / count(*) AS exclusive_rate FROM fps JOIN per USING (fp) GROUP BY 1",
    "overlap_pairwise": f"""WITH {_FP}, sizes AS (SELECT source, count(*) AS n FROM fps GROUP BY 1), sh AS (SELECT a.source AS a, b.source AS b, count(*) AS n FROM fps a JOIN fps b ON a.fp = b.fp AND a.source < b.source GROUP BY 1, 2)
        SELECT x.source AS source_a, y.source AS source_b, coalesce(sh.n, 0) AS shared, {ratio_sql('coalesce(sh.n, 0)', '(x.n + y.n - coalesce(sh.n, 0))')} AS jaccard, coalesce(sh.n, 0)::DOUBLE / x.n AS share_of_a, coalesce(sh.n, 0)::DOUBLE / y.n AS share_of_b FROM sizes x JOIN sizes y ON x.source < y.source LEFT JOIN sh ON sh.a = x.source AND sh.b = y.source""",
    "overlap_global": f"WITH {_FP} SELECT count(*) AS fingerprints, count(*) FILTER (WHERE n > 1) AS shared FROM (SELECT fp, count(*) AS n FROM fps GROUP BY 1)",
    "source_identity_metrics": f"""SELECT *, {ratio_sql('named', 'postings')} AS named_rate, {ratio_sql('resolved', 'postings')} AS resolved_rate FROM (SELECT lower(trim(source)) AS source, count(*) AS postings, count(nullif(trim(company_name_raw), '')) AS named, count(nullif(trim(city), '')) AS placed, count(company_id) AS resolved, count(DISTINCT company_id) AS companies,
        count(*) FILTER (WHERE CAST(company_name_confidence AS DECIMAL(6,4)) >= 0.8) AS sure, CAST(sum(CAST(company_name_confidence AS DECIMAL(6,4))) AS DOUBLE) AS confidence_sum, count(*) FILTER (WHERE company_resolution_method IN ('new_company', 'ambiguous_exact_name', 'insufficient_cross_city_evidence')) AS created FROM job_postings GROUP BY 1)""",
    "resolution_method_stats": "SELECT coalesce(company_resolution_method, 'legacy') AS method, count(*) AS postings, CAST(sum(CAST(company_resolution_confidence AS DECIMAL(6,4))) AS DOUBLE) AS confidence_sum, count(company_resolution_confidence) AS with_confidence FROM job_postings GROUP BY 1",
    "source_provenance_metrics": f"""SELECT *, {ratio_sql('identified_companies', 'companies')} AS identified_rate FROM (SELECT coalesce(p.source, i.source) AS source, coalesce(postings, 0) AS postings, coalesce(companies, 0) AS companies, coalesce(identifier_rows, 0) AS identifier_rows, CAST(coalesce(observations, 0) AS BIGINT) AS observations, coalesce(identified_companies, 0) AS identified_companies, coalesce(register_rows, 0) AS register_rows, coalesce(strong_rows, 0) AS strong_rows
        FROM (SELECT source, count(*) AS postings, count(DISTINCT company_id) AS companies FROM job_postings GROUP BY 1) p FULL JOIN (SELECT job_source AS source, count(*) AS identifier_rows, sum(observation_count) AS observations, count(DISTINCT company_id) AS identified_companies, count(*) FILTER (WHERE lower(kind) IN ('nip', 'regon', 'krs')) AS register_rows, count(*) FILTER (WHERE confidence >= 0.95) AS strong_rows FROM company_identifier_observations GROUP BY 1) i ON i.source = p.source)""",
    "source_run_metrics": f"""SELECT *, {ratio_sql('successes', 'runs')} AS success_rate, {ratio_sql('total_us', 'jobs_seen')} AS us_per_job_seen FROM (SELECT source, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'failed') AS failures, CAST(coalesce(sum(jobs_seen), 0) AS BIGINT) AS jobs_seen, CAST(coalesce(sum(jobs_inserted), 0) AS BIGINT) AS jobs_inserted, count(finished_at) AS finished, CAST(sum(epoch_us(finished_at) - epoch_us(started_at)) AS BIGINT) AS total_us FROM source_runs GROUP BY 1)""",
    "source_health": r"""SELECT p.source, coalesce(runs, 0) AS runs, coalesce(successes, 0) AS successes, coalesce(failures, 0) AS failures, last_status, last_success_at, last_error,
        CASE WHEN last_status IS NULL THEN 'unexercised' WHEN last_status <> 'success' AND regexp_matches(last_message, '\b(401|403|429)\b|robots') THEN 'blocked' WHEN last_status <> 'success' THEN 'failing' WHEN coalesce(last_seen, 0) = 0 THEN 'empty' ELSE 'healthy' END AS state
        FROM portals p LEFT JOIN (SELECT source, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'failed') AS failures, arg_max(status, id) AS last_status, arg_max(coalesce(error_message, ''), id) AS last_message, arg_max(coalesce(jobs_seen, 0), id) AS last_seen, max(started_at) FILTER (WHERE status = 'success') AS last_success_at, arg_max(error_type, id) FILTER (WHERE error_type IS NOT NULL) AS last_error FROM source_runs GROUP BY 1) r USING (source)""",
    "downstream_by_source": "SELECT source, count(*) AS companies, count(*) FILTER (WHERE website_url IS NOT NULL) AS with_site, count(enriched_at) AS enriched, CAST(coalesce(sum(contacts), 0) AS BIGINT) AS contacts, count(*) FILTER (WHERE green > 0) AS with_green FROM (SELECT DISTINCT source, company_id FROM job_postings WHERE company_id IS NOT NULL) p JOIN companies c ON c.id = p.company_id LEFT JOIN (SELECT company_id, count(*) FILTER (WHERE decision = 'green') AS green, count(*) AS contacts FROM contact_channels GROUP BY 1) g ON g.company_id = p.company_id GROUP BY 1",
    "leads": f"""WITH {_ID}, g AS (SELECT company_id, list({'{'}'v': value, 'k': kind{'}'} ORDER BY confidence DESC, kind, value) AS l FROM contact_channels WHERE decision = 'green' GROUP BY 1),
        i AS (SELECT company_id, min(value) FILTER (WHERE kind = 'nip') AS nip, min(value) FILTER (WHERE kind = 'regon') AS regon, min(value) FILTER (WHERE kind = 'krs') AS krs FROM cur GROUP BY 1),
        j AS (SELECT company_id, count(*) AS jobs, string_agg(DISTINCT source, ' | ' ORDER BY source) AS sources FROM job_postings GROUP BY 1)
        SELECT g.company_id, canonical_name, city, l[1].k AS primary_kind, l[1].v AS primary_value, array_to_string(list_transform(l, lambda x: x.v), ' | ') AS contacts, coalesce(jobs, 0) AS jobs, sources, nip, regon, krs
        FROM g JOIN companies c ON c.id = g.company_id LEFT JOIN j ON j.company_id = g.company_id LEFT JOIN i ON i.company_id = g.company_id""",
    "shared_contacts": "SELECT kind, lower(value) AS value, count(DISTINCT company_id) AS companies, min(company_id) AS first_company_id FROM contact_channels GROUP BY 1, 2 HAVING count(DISTINCT company_id) > 1",
    "latest_snapshots": "SELECT contact_channel_id, id, company_id, content_sha256, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY contact_channel_id ORDER BY id DESC) AS rn FROM contact_evidence_snapshots) WHERE rn = 1",
    "evidence_changes": "SELECT id, contact_channel_id, content_sha256, lag(content_sha256) OVER w AS previous, coalesce(lag(content_sha256) OVER w <> content_sha256, false) AS changed FROM contact_evidence_snapshots WINDOW w AS (PARTITION BY contact_channel_id ORDER BY id)",
    "evidence_hash_check": "SELECT id, sha256(evidence_text) AS sha256, coalesce(sha256(evidence_text) = content_sha256, false) AS same FROM contact_evidence_snapshots",
    "attempts_first_accepted": "SELECT company_id, id, accepted, rank FROM (SELECT *, min(CASE WHEN accepted THEN rank END) OVER (PARTITION BY company_id) AS f FROM (SELECT company_id, id, decision = 'green' AS accepted, row_number() OVER (PARTITION BY company_id ORDER BY confidence DESC, id) AS rank FROM contact_channels)) WHERE f IS NULL OR rank <= f",
    "benchmark_counts": """SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(website_url) FROM companies) AS with_website, (SELECT count(enriched_at) FROM companies) AS enriched, (SELECT count(*) FROM companies WHERE identity_confidence BETWEEN 0.95 AND 1) AS sure_identity,
        (SELECT count(*) FROM job_postings) AS postings, (SELECT count(DISTINCT source) FROM job_postings) AS sources, (SELECT count(DISTINCT company_id) FROM job_postings) AS companies_with_postings, (SELECT count(*) FROM contact_channels) AS channels, (SELECT count(*) FROM contact_channels WHERE decision = 'green') AS green,
        (SELECT count(*) FROM contact_channels WHERE decision = 'review') AS review, (SELECT count(DISTINCT company_id) FROM contact_channels WHERE decision = 'green') AS companies_with_green, (SELECT count(*) FROM source_runs) AS runs, (SELECT count(*) FROM source_runs WHERE status = 'failed') AS failed_runs""",
    "confidence_bands": "SELECT CASE WHEN identity_confidence IS NULL OR isnan(identity_confidence) OR identity_confidence < 0 OR identity_confidence > 1 THEN 'unknown' WHEN identity_confidence < 0.5 THEN 'low' WHEN identity_confidence < 0.8 THEN 'medium' WHEN identity_confidence < 0.95 THEN 'high' ELSE 'very_high' END AS band, count(*) AS companies FROM companies GROUP BY 1",
    "contact_confusion": f"WITH {_CONFUSION} SELECT * FROM cm",
    "contact_metrics": f"""WITH {_CONFUSION}, t AS (SELECT truth AS class, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS BIGINT) AS hits FROM cm GROUP BY 1), p AS (SELECT predicted AS class, CAST(sum(n) AS BIGINT) AS predicted FROM cm GROUP BY 1)
        SELECT class, support, hits, predicted, {ratio_sql('hits', 'predicted')} AS precision, {ratio_sql('hits', 'support')} AS recall, {ratio_sql('(2 * hits)', '(predicted + support)')} AS f1 FROM t JOIN p USING (class)""",
    "website_eval": f"""WITH x AS (SELECT p, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN 'other.example' ELSE p END AS t FROM (SELECT id, {host_sql('website_url')} AS p FROM companies)),
        g AS (SELECT count(*) FILTER (WHERE t = p) AS tp, count(*) FILTER (WHERE p IS NOT NULL AND t IS DISTINCT FROM p) AS fp, count(*) FILTER (WHERE t IS NOT NULL AND t IS DISTINCT FROM p) AS fn, count(*) FILTER (WHERE t IS NULL AND p IS NULL) AS tn, count(*) FILTER (WHERE t <> p) AS wrong_domain FROM x)
        SELECT *, {ratio_sql('tp', '(tp + fp)')} AS precision, {ratio_sql('tp', '(tp + fn)')} AS recall, {ratio_sql('(2 * tp)', '(2 * tp + fp + fn)')} AS f1 FROM g""",
    "pairwise_resolution_eval": f"""WITH x AS (SELECT coalesce({legal_sql(fold_sql('company_name_raw'))}, '') || CASE WHEN company_name_raw IS NULL THEN '' ELSE '|' END || coalesce({fold_sql('city')}, '') AS t, company_id AS p FROM job_postings WHERE company_id IS NOT NULL),
        g AS (SELECT (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY t, p)) AS "both", (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY t)) AS in_truth, (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY p)) AS in_prediction)
        SELECT *, {ratio_sql('"both"', 'in_prediction')} AS precision, {ratio_sql('"both"', 'in_truth')} AS recall, {ratio_sql('(2 * "both")', '(in_truth + in_prediction)')} AS f1 FROM g""",
    "label_status": "WITH x AS (SELECT CASE WHEN id % 4 = 0 THEN '' WHEN id % 13 = 0 THEN '__exclude__' ELSE coalesce(lower(trim(decision)), '') END AS v FROM contact_channels) SELECT count(*) AS total, count(*) FILTER (WHERE v = '') AS blank, count(*) FILTER (WHERE v = '__exclude__') AS excluded, count(*) FILTER (WHERE v IN ('green', 'review', 'ignore')) AS labelled, count(*) FILTER (WHERE v NOT IN ('', '__exclude__', 'green', 'review', 'ignore')) AS invalid FROM x",
    "stratified_sample": f"WITH {_STRATA}, {_TAKE} SELECT id, source, method FROM (SELECT id, source, coalesce(company_resolution_method, 'legacy') AS method, source || '|' || coalesce(company_resolution_method, 'legacy') AS stratum, row_number() OVER (PARTITION BY source || '|' || coalesce(company_resolution_method, 'legacy') ORDER BY sha256('seed' || chr(31) || 'row' || chr(31) || id::VARCHAR)) AS rn FROM job_postings) JOIN take USING (stratum) WHERE rn <= take",
    "sample_allocation": f"WITH {_STRATA}, {_TAKE} SELECT * FROM take",
    "review_all_block_pairs": f"""
        WITH f AS (
            SELECT id, normalized_name AS name, replace(normalized_name, ' ', '') AS bare, {host_sql("website_url")} AS host, website_confidence::VARCHAR NOT IN ('nan', '-nan') AND website_confidence >= 0.8 AS sure
            FROM companies WHERE normalized_name IS NOT NULL),
        k AS (
            SELECT id, 'token ' || w AS key FROM (SELECT id, unnest(string_split(name, ' ')) AS w FROM f) WHERE length(w) >= 4
            UNION SELECT id, 'prefix ' || left(bare, 4) FROM f WHERE length(bare) >= 6
            UNION SELECT id, 'suffix ' || right(bare, 4) FROM f WHERE length(bare) >= 6
            UNION SELECT id, 'website ' || host FROM f WHERE sure AND host IS NOT NULL)
        SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id""",
    "url_hosts": f"SELECT {host_sql('url')} AS host, count(*) AS postings FROM job_postings GROUP BY 1",
    "emails_in_text": r"SELECT email, count(*) AS snapshots FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(evidence_text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')) AS email FROM contact_evidence_snapshots) GROUP BY 1",
    "folded_names": f"SELECT id, {legal_sql(fold_sql('company_name_raw'))} AS name, {fold_sql('city')} AS city FROM job_postings",
    "run_windows": "SELECT source, epoch_us(date_trunc('day', started_at)) AS day_us, count(*) AS runs, CAST(coalesce(sum(jobs_seen), 0) AS BIGINT) AS jobs_seen FROM source_runs WHERE started_at IS NOT NULL GROUP BY 1, 2",
}
