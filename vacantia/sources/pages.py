"""Postings from recorded HTML pages of portals, driven by a table of portals.

A page gives the posting of its structured data, else one read by the portal's selectors. Listing
pages give the addresses of offers; sitemaps theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.urls import canonical_url
from vacantia.html.dom import Node, parse
from vacantia.html.jsonld import job_posting
from vacantia.schemas import POSTING


@dataclass(frozen=True)
class Portal:
    """How one portal's pages are read."""

    name: str
    base: str
    listing: str
    offers: tuple[str, ...]
    company: tuple[str, ...] = ()
    city: tuple[str, ...] = ()
    description: tuple[str, ...] = ("main", "article")
    title: tuple[str, ...] = ("h1",)
    most_links: int = 50


# Portals with their addresses, offer paths and selectors.
PORTALS = {p.name: p for p in (
    Portal("nofluffjobs", "https://nofluffjobs.com", "https://nofluffjobs.com/pl/poland", (r"^/pl/job/",), ("a[href*='/company/']",), most_links=30),
    Portal("bulldogjob", "https://bulldogjob.pl", "https://bulldogjob.pl/companies/jobs", (r"^/companies/jobs/\d+-",), ("a[href*='/companies/profiles/']", "[class*='company-name']"), ("[class*='location']",), most_links=100),
    Portal("justjoinit", "https://justjoin.it", "https://justjoin.it/job-offers/all-locations", (r"^/job-offer/",), ("a[href*='/company/']", "a[href*='/companies/']")),
    Portal("rocketjobs", "https://rocketjobs.pl", "https://rocketjobs.pl/", (r"^/oferta-pracy/",), ("a[href*='/brands/story/']", "[data-testid*='company']", ".company-name")),
    Portal("karierawfinansach", "https://www.karierawfinansach.pl", "https://www.karierawfinansach.pl/", (r"^/oferta-pracy/\d+",), ("a[href*='/pracodawca/']", ".company-name"), description=("main", "article", ".offer-content")),
    Portal("skillshot", "https://www.skillshot.pl", "https://www.skillshot.pl/jobs?page={page}", (r"^/jobs/\d+-",), ("a[href*='/users/']",), description=("main", "article", ".job-description"), most_links=40),
    Portal("theprotocol", "https://theprotocol.it", "https://theprotocol.it/praca?pageNumber={page}", (r"^/praca/.+,oferta,", r"^/szczegoly/praca/.+,oferta,"), ("a[href*='/firmy/']", "[data-testid*='company']", ".company-name"), ("[data-testid*='location']", ".location")),
)}


def _first(page: Node, selectors: tuple[str, ...]) -> str | None:
    return next((t for s in selectors for n in page.select(s)[:1] if (t := n.text())), None)


def page_posting(portal: Portal, url: str, html: str | None) -> dict | None:
    """The posting of a page, or None without a title and a firm."""
    page = parse(html)
    found = job_posting(url, page, portal.name)
    if found:
        return found
    title, firm = _first(page, portal.title), _first(page, portal.company)
    if not title or not firm:
        return None
    link = next((n.get("href") for n in page.find_all("link") if "canonical" in n.get("rel").lower().split()), "")
    own = (canonical_url(link, url) if link else None) or url
    return {
        "source": portal.name, "source_id": own, "url": own, "title": title, "company_name": firm, "company_name_source": "html.selector", "company_name_confidence": 0.8, "company_identifiers": [], "company_website_candidates": [],
        "city": _first(page, portal.city), "description": _first(page, portal.description), "published_at": None, "refreshed_at": None,
    }


def offer_links(portal: Portal, listing: str, html: str | None) -> list[str]:
    """Addresses of offers on a listing page: the portal's host and paths, each once, in order."""
    host = urlsplit(portal.base).netloc.lower()
    out: dict[str, None] = {}
    for a in parse(html).find_all("a"):
        u = canonical_url(a.get("href"), listing) if a.get("href") else None
        if u and urlsplit(u).netloc == host and any(re.search(p, unquote(urlsplit(u).path), re.I) for p in portal.offers):
            out.setdefault(u)
    return list(out)[: portal.most_links]


def sitemap_locations(xml: str) -> tuple[str, list[str]]:
    """(sitemapindex or urlset, its locations); other documents give ('', [])."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return "", []
    kind = root.tag.rsplit("}", 1)[-1]
    if kind not in ("sitemapindex", "urlset"):
        return "", []
    return kind, [t for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "loc" and (t := (e.text or "").strip())]


def page_postings(payloads: DataFrame, portals: dict[str, Portal] = PORTALS) -> DataFrame:
    """Postings of recorded pages (source, url, body) of the portals; other sources are passed over."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [p for s, u, b in zip(f["source"], f["url"], f["body"]) if s in portals and u and (p := page_posting(portals[s], u, b))]
            if rows:
                yield pd.DataFrame(rows)

    return payloads.select("source", "url", "body").mapInPandas(run, POSTING)


def listing_links(payloads: DataFrame, portals: dict[str, Portal] = PORTALS) -> DataFrame:
    """source, listing_url, position, url of every offer link of recorded listing pages."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(s, u, i, x) for s, u, b in zip(f["source"], f["url"], f["body"]) if s in portals and u for i, x in enumerate(offer_links(portals[s], u, b))], columns=["source", "listing_url", "position", "url"])

    return payloads.select("source", "url", "body").mapInPandas(run, "source string, listing_url string, position int, url string")


def sitemap_links(payloads: DataFrame, portals: dict[str, Portal] = PORTALS) -> DataFrame:
    """source, kind, url of the locations of recorded sitemaps; of url sets only offers, each once."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, b in zip(f["source"], f["body"]):
                kind, found = sitemap_locations(b or "")
                keep = portals[s].offers if s in portals and kind == "urlset" else None
                rows += [(s, kind, u) for u in dict.fromkeys(found) if keep is None or any(re.search(p, unquote(urlsplit(u).path), re.I) for p in keep)]
            yield pd.DataFrame(rows, columns=["source", "kind", "url"])

    return payloads.select("source", "body").mapInPandas(run, "source string, kind string, url string").distinct()


def crawl_frontier(links: DataFrame, pages_per_site: int = 12) -> DataFrame:
    """The first pages to fetch of each site by priority, then order of discovery, each address once.

    `links` has site, url, priority and seq.
    """
    from pyspark.sql import Window

    once = links.groupBy("site", "url").agg(F.min(F.struct("priority", "seq")).alias("p"))
    w = Window.partitionBy("site").orderBy("p", "url")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pages_per_site).select("site", "url", F.col("p.priority").alias("priority"), "rank")
