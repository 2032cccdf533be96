"""Postings from recorded JSON responses: one description per feed, one native plan for all of them.

A response is parsed with the feed's schema (unreadable ones give no postings), its records are
spread, and records without one of the required values are dropped. Nothing leaves the JVM.
"""

from __future__ import annotations

import base64
import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import blank_to_null
from vacantia.schemas import POSTING


@dataclass(frozen=True)
class Feed:
    """Where a feed's records and their values are. Values are paths within a record."""

    name: str
    schema: str
    records: str
    confidence: float
    named_by: str
    values: dict[str, str]
    only_if: str = ""
    extra: dict[str, str] = field(default_factory=dict)


# The feeds' field names and the confidence in their firm names.
FEEDS = {
    "adzuna": Feed(
        "adzuna", "results array<struct<id:string,title:string,redirect_url:string,description:string,created:string,company:struct<display_name:string>,location:struct<display_name:string>>>", "results", 0.97, "api.company.display_name",
        {"source_id": "id", "title": "title", "url": "redirect_url", "company_name": "company.display_name", "city": "location.display_name", "description": "description", "published_at": "created"},
    ),
    "jooble": Feed(
        "jooble", "jobs array<struct<id:string,title:string,link:string,company:string,location:string,snippet:string,updated:string>>", "jobs", 0.97, "api.company",
        {"source_id": "id", "title": "title", "url": "link", "company_name": "company", "city": "location", "description": "snippet", "refreshed_at": "updated"},
    ),
    "careerjet": Feed(
        "careerjet", "type string, jobs array<struct<url:string,title:string,company:string,locations:string,description:string,date:string>>", "jobs", 0.96, "api.company",
        {"source_id": "", "title": "title", "url": "url", "company_name": "company", "city": "locations", "description": "description", "published_at": "date"}, only_if="trim(_p.type) = 'JOBS'",
    ),
}
REQUIRED = ("source_id", "url", "title", "company_name")


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def feed_postings(payloads: DataFrame, feed: Feed) -> DataFrame:
    """Postings of a feed's responses (`payloads` has source and body)."""
    p = payloads.filter(F.col("source") == feed.name).select(F.from_json("body", feed.schema).alias("_p"))
    if feed.only_if:
        p = p.filter(feed.only_if)
    r = p.select(F.explode(f"_p.{feed.records}").alias("_r"))
    value = {k: blank_to_null(F.col(f"_r.{path}")) if path else F.lit(None).cast("string") for k, path in feed.values.items()}
    if not feed.values["source_id"]:
        value["source_id"] = F.substring(F.sha2(value["url"], 256), 1, 24)
    got = r.select(F.lit(feed.name).alias("source"), *[value.get(c, F.lit(None).cast("string")).alias(c) for c in (*REQUIRED, "city", "description", "published_at", "refreshed_at")]).dropna(subset=list(REQUIRED))
    return got.select(
        "source", "source_id", "url", "title", "company_name", F.lit(feed.named_by).alias("company_name_source"), F.lit(feed.confidence).alias("company_name_confidence"),
        _empty("array<struct<kind:string,value:string,source:string,confidence:double>>").alias("company_identifiers"), _empty("array<struct<url:string,source:string,confidence:double>>").alias("company_website_candidates"),
        "city", "description", "published_at", "refreshed_at",
    )


# ---- the official feed: JSON files in a zip, in base64, in a SOAP answer ----


def official_archive(answer: bytes | str) -> bytes | None:
    """The zip that a SOAP answer carries: its longest text that decodes to one."""
    try:
        root = ElementTree.fromstring(answer)
    except ElementTree.ParseError:
        return None
    for text in sorted(("".join((e.text or "").split()) for e in root.iter()), key=len, reverse=True):
        try:
            data = base64.b64decode(text, validate=True)
        except ValueError:
            continue
        if data[:4] == b"PK\x03\x04":
            return data
    return None


def official_records(value) -> list[dict]:
    """The offers within a payload, wherever its envelope keeps them."""
    if isinstance(value, list):
        return [v for v in value if isinstance(v, dict)]
    if not isinstance(value, dict):
        return []
    if value.get("stanowisko") and value.get("pracodawca"):
        return [value]
    return next((found for key in ("oferty", "offers", "data", "listaOfert") if (found := official_records(value.get(key)))), [])


def official_posting(o: dict) -> dict | None:
    """A posting of an offer, or None without one of the required values."""

    def said(*keys: str) -> str | None:
        return next((s for k in keys if isinstance(o.get(k), (str, int)) and (s := str(o[k]).strip())), None)

    places = o.get("adresyMiejscPracy")
    place = next((s for p in (places if isinstance(places, list) else []) if isinstance(p, dict) and (s := str(p.get("miejscowosc") or "").strip())), None)
    row = {
        "source": "epraca", "source_id": said("identyfikatorOferty", "hash"), "url": said("link"), "title": said("stanowisko", "stanowiskoNrm"), "company_name": said("pracodawca"),
        "company_name_source": "official_feed.pracodawca", "company_name_confidence": 0.995,
        "company_identifiers": [{"kind": k, "value": v, "source": f"official_feed.{k}", "confidence": 0.995} for k in ("nip", "regon") if (v := said(k))],
        "company_website_candidates": [{"url": v, "source": "official_feed.adresWww", "confidence": 0.98} for v in [said("adresWww")] if v],
        "city": said("miejscowosc", "miejscePracyCzlonPierwszy") or place, "description": said("zakresObowiazkow", "rodzajObowiazkow"), "published_at": said("dataDodaniaOferty"), "refreshed_at": said("dataAktualizacji"),
    }
    return row if all(row[k] for k in REQUIRED) else None


def official_postings(answers: DataFrame, body: str = "body") -> DataFrame:
    """Postings of SOAP answers or bare archives (a binary or string column)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for b in f["body"]:
                data = None if b is None else bytes(b)
                archive = data if data and data[:4] == b"PK\x03\x04" else official_archive(data) if data else None
                if archive:
                    with zipfile.ZipFile(io.BytesIO(archive)) as z:
                        for name in z.namelist():
                            if name.lower().endswith(".json"):
                                rows += [p for o in official_records(json.loads(z.read(name).decode("utf-8-sig"))) if (p := official_posting(o))]
            if rows:
                yield pd.DataFrame(rows)

    return answers.select(F.col(body).cast("binary").alias("body")).mapInPandas(run, POSTING)
