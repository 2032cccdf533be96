"""What is known of every source: how it is reached, what it needs, who reads it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """A source of postings; `reader` names the function that reads its recorded payloads."""

    name: str
    access: str
    reader: str
    env: tuple[str, ...] = ()


# Sources with their access modes and the settings a connector needs.
SOURCES = {s.name: s for s in (
    Source("adzuna", "partner_api", "json_feeds", ("ADZUNA_APP_ID", "ADZUNA_APP_KEY")), Source("jooble", "partner_api", "json_feeds", ("JOOBLE_API_KEY",)), Source("careerjet", "partner_api", "json_feeds", ("CAREERJET_API_KEY",)),
    Source("epraca", "official_partner_feed", "official_feed"), Source("olx", "public_web_endpoint", "portal_pages"), Source("kprm", "official_public_html", "portal_pages"), Source("ngo", "public_html", "portal_pages"),
    Source("aplikuj", "public_html", "portal_pages"), Source("manpower", "public_html", "portal_pages"), Source("randstad", "public_html", "portal_pages"), Source("ofertypracyedu", "public_html", "portal_pages"),
    Source("rocketjobs", "public_html", "pages"), Source("karierawfinansach", "public_html", "pages"), Source("skillshot", "public_html", "pages"),
    Source("nofluffjobs", "public_html", "pages"), Source("bulldogjob", "public_html", "pages"), Source("justjoinit", "public_html", "pages"), Source("theprotocol", "public_html", "pages"),
)}


def sources_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.name, s.access, s.reader, list(s.env)) for _, s in sorted(SOURCES.items())], "name string, access string, reader string, env array<string>")


def postings(payloads: DataFrame) -> DataFrame:
    """Postings of recorded payloads (source, url, body) of all sources; unknown sources give none.

    Feeds are read natively and pages by one Arrow pass each over the rows of their sources; the
    results share one schema.
    """
    from vacantia.sources import json_feeds, pages, portal_pages

    by = {kind: [s.name for s in SOURCES.values() if s.reader == kind] for kind in {s.reader for s in SOURCES.values()}}
    own = lambda kind: payloads.filter(payloads["source"].isin(by[kind]))
    out = pages.page_postings(own("pages")).unionByName(portal_pages.portal_postings(own("portal_pages"))).unionByName(json_feeds.official_postings(own("official_feed")))
    for feed in json_feeds.FEEDS.values():
        out = out.unionByName(json_feeds.feed_postings(own("json_feeds"), feed))
    return out
