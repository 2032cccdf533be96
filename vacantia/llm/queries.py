"""Queries pN_... of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import identifier_groups as p3
from vacantia.llm import mixture as p9
from vacantia.llm import names as p1
from vacantia.llm import near_duplicates as p2
from vacantia.llm import places as p5
from vacantia.llm import residue as p4
from vacantia.llm import subjects as p10
from vacantia.llm import survivors as p6
from vacantia.llm import tokenize as p8
from vacantia.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id_a, company_id_b of rows of one employer under different names."""
    tables = (table(spark, sf_dir, t) for t in ("companies", "company_aliases", "job_postings", "city_reference", "portals"))
    return p1.variant_pairs(p1.employer_clusters(*tables))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observation_id_a, observation_id_b of adverts reposted with small changes."""
    return p2.near_duplicate_pairs(table(spark, sf_dir, "job_posting_observations"), "id", ["title", "description"], "description", ["source", "source_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company_id, group_id of companies tied by identifiers."""
    return p3.identifier_groups(table(spark, sf_dir, "company_identifier_observations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_table, record_id of texts that are residue of templates or failed pages."""
    return p4.found_residue(table(spark, sf_dir, "job_postings"), table(spark, sf_dir, "contact_evidence_snapshots"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_table, record_id, city_id of every non-blank city of postings and companies."""
    return p5.located_records({t: table(spark, sf_dir, t) for t in ("job_postings", "companies")}, table(spark, sf_dir, "city_reference"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, website_company_id, identity_company_id of companies with equal name and city."""
    return p6.company_survivors(table(spark, sf_dir, "companies"), table(spark, sf_dir, "source_trust"), table(spark, sf_dir, "portals"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document by byte_bpe_50k."""
    return p8.encode_documents(table(spark, sf_dir, "documents"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, copies of every document of the mixture."""
    return p9.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source was to contribute and what it contributes."""
    return p9.mixture_shares(*p9.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, subject of every subject area a document is about."""
    return p10.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_areas", "subject_samples")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found}

SQL = {
    "p2_found": r"""
        WITH o AS (
            SELECT id, source, source_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || description), '[\p{L}\p{N}]+') AS w
            FROM job_posting_observations WHERE description IS NOT NULL AND regexp_matches(description, '\S')),
        n AS (SELECT w, row_number() OVER () AS t FROM (SELECT DISTINCT w FROM o)),
        s AS (SELECT DISTINCT t, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT t, w, unnest(range(1, len(w) - 1)) AS i FROM n)),
        c AS (SELECT t, count(*) AS k FROM s GROUP BY 1),
        p AS (SELECT a.t AS t1, b.t AS t2, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.t < b.t GROUP BY 1, 2),
        m AS (SELECT t1, t2 FROM p JOIN c x ON x.t = t1 JOIN c y ON y.t = t2 WHERE 10 * p.k >= 6 * (x.k + y.k - p.k) UNION ALL SELECT t, t FROM c),
        r AS (SELECT id, source, source_id, t FROM o JOIN n USING (w))
        SELECT least(a.id, b.id) AS observation_id_a, greatest(a.id, b.id) AS observation_id_b
        FROM m JOIN r a ON a.t = t1 JOIN r b ON b.t = t2 AND (t1 <> t2 OR a.id < b.id)
        WHERE NOT coalesce(a.source = b.source AND a.source_id = b.source_id, false)""",
    "p3_found": r"""
        WITH RECURSIVE digits AS (
            SELECT company_id, lower(trim(kind)) AS k, value, regexp_replace(value, '[^0-9]', '', 'g') AS d
            FROM company_identifier_observations),
        keyed AS (
            SELECT DISTINCT company_id, k || ':' || d AS key FROM digits
            WHERE k IN ('nip', 'regon', 'krs') AND length(d) = CASE k WHEN 'regon' THEN 9 ELSE 10 END
              AND NOT contains('01234567890123456789', d) AND NOT contains('98765432109876543210', d)
              AND d <> repeat(d[1], length(d))
            UNION
            SELECT DISTINCT company_id, k || ':' || lower(regexp_extract(value, '^\s*[A-Za-z]+://([^/?#\s]+)', 1))
                   || rtrim(regexp_extract(value, '^\s*[A-Za-z]+://[^/?#\s]+([^?#\s]*)', 1), '/') FROM digits
            WHERE k LIKE '%\_employer\_profile' ESCAPE '\' AND value LIKE '%://%/%'),
        tie AS (SELECT DISTINCT a.company_id AS a, b.company_id AS b FROM keyed a JOIN keyed b USING (key) WHERE a.company_id <> b.company_id),
        reach(a, b) AS (SELECT a, b FROM tie UNION SELECT r.a, t.b FROM reach r JOIN tie t ON t.a = r.b)
        SELECT a AS company_id, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
    "p6_found": r"""
        WITH hosts AS (SELECT DISTINCT regexp_replace(lower(host), '^www\.', '') AS h FROM portals),
        trust AS (SELECT regexp_replace(lower(trim(identity_source)), '[-_\s]+', '_', 'g') AS s, min(trust_rank) AS r FROM source_trust GROUP BY 1),
        c AS (
            SELECT id, normalized_name AS n, normalized_city AS ci, updated_at, r,
                   CASE WHEN identity_confidence BETWEEN 0 AND 1 THEN identity_confidence END AS conf,
                   regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(website_url), '^(https?:)?//', '', 'i'), '^([^/?#\s]*)', 1)), ':[0-9]*$|\.$', ''), '^www\.', '') AS host
            FROM companies LEFT JOIN trust ON s = regexp_replace(lower(trim(identity_source)), '[-_\s]+', '_', 'g')
            WHERE normalized_name IS NOT NULL AND normalized_city IS NOT NULL),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY n, ci ORDER BY r NULLS LAST, conf DESC NULLS LAST, updated_at DESC NULLS LAST, id) AS rn,
                   regexp_full_match(coalesce(host, ''), '[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+') AND host NOT IN (SELECT h FROM hosts) AS web FROM c)
        SELECT min(id) AS group_id, coalesce(arg_min(id, rn) FILTER (WHERE web), 0) AS website_company_id,
               coalesce(arg_min(id, rn) FILTER (WHERE r IS NOT NULL AND conf IS NOT NULL), 0) AS identity_company_id
        FROM o GROUP BY n, ci HAVING count(*) > 1""",
}
