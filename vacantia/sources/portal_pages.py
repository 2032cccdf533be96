"""Postings of portals whose pages need reading of their own: embedded state, labelled values, announcements."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from vacantia.functions.urls import website_candidate
from vacantia.html.dom import Node, parse
from vacantia.html.jsonld import job_posting
from vacantia.operators.timestamps import MONTHS
from vacantia.schemas import POSTING


def _row(source: str, source_id: str, url: str, title: str, firm: str, named_by: str, confidence: float, **more) -> dict:
    blank = {"company_identifiers": [], "company_website_candidates": [], "city": None, "description": None, "published_at": None, "refreshed_at": None}
    return {"source": source, "source_id": source_id, "url": url, "title": title, "company_name": firm, "company_name_source": named_by, "company_name_confidence": confidence} | blank | more


def _said(value) -> str | None:
    return str(value).strip() or None if isinstance(value, (str, int, float)) and not isinstance(value, bool) else None


def _at(value, *path: str):
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def lines(page: Node) -> list[str]:
    return [t for _, raw in page.texts() if (t := " ".join(raw.split()))]


def polish_date(text: str) -> str | None:
    """The first date written with a month's name, in ISO form."""
    for d, name, y in re.findall(r"\b(\d{1,2})\s+(\w+)\s+(\d{4})\b", text):
        month = MONTHS.get(name.lower())
        if month and 1 <= int(d) <= 31:
            return f"{y}-{month:02d}-{int(d):02d}"
    return None


# ---- state embedded in a listing page ----

_STATE = re.compile(r"window\.__PRERENDERED_STATE__\s*=\s*(\"(?:[^\"\\]|\\.)*\"|\{.*?\})\s*;", re.S)
# Where an ad names its firm, the surest place first.
_FIRM_PATHS = (
    (("company", "name"), 0.98), (("companyName",), 0.96), (("businessName",), 0.95), (("user", "companyName"), 0.95), (("employer", "name"), 0.95), (("contact", "name"), 0.55), (("user", "name"), 0.45),
)


def state_postings(url: str, html: str | None, base: str = "https://www.olx.pl") -> list[dict]:
    """Postings of the ads in a listing page's embedded state, each once."""
    m = _STATE.search(html or "")
    try:
        state = json.loads(m[1]) if m else None
        state = json.loads(state) if isinstance(state, str) else state
    except ValueError:
        return []
    ads = _at(state, "listing", "listing", "ads")
    out: dict[str, dict] = {}
    for ad in ads if isinstance(ads, list) else []:
        source_id, title, link = _said(_at(ad, "id")), _said(_at(ad, "title")), _said(_at(ad, "url"))
        if not source_id or not title or not link:
            continue
        firm, path, sure = next(((v, ".".join(p), c) for p, c in _FIRM_PATHS if (v := _said(_at(ad, *p)))), (f"Nieujawniony pracodawca OLX #{source_id}", "olx.identity_not_public", 0.0))
        place = _said(_at(ad, "location", "cityName")) or ((_said(_at(ad, "location", "pathName")) or "").split(",")[0].strip() or None)
        text = _said(_at(ad, "description"))
        out.setdefault(source_id, _row("olx", source_id, urljoin(base, link), title, firm, path, sure, city=place, description=parse(re.sub(r"(?i)<br\s*/?>", "\n", text)).text() if text else None, published_at=_said(_at(ad, "createdTime")), refreshed_at=_said(_at(ad, "lastRefreshTime"))))
    return list(out.values())


# ---- announcements of the civil service ----

_ANNOUNCEMENT = re.compile(r"Ogłoszenie\s+nr\s+(\d+)\s*/\s*(\d{2})\.(\d{2})\.(\d{4})")


def announcement_posting(url: str, html: str | None) -> list[dict]:
    page = parse(html)
    title = page.find("h1")
    seen = lines(page)
    m = _ANNOUNCEMENT.search("\n".join(seen))
    number = m[1] if m else (re.search(r",(\d+),v\d+$", unquote(urlsplit(url).path)) or [None, None])[1]
    at = next((i for i, line in enumerate(seen) if _ANNOUNCEMENT.search(line)), 0)
    firm = next((x for x in reversed(seen[max(0, at - 6) : at]) if len(x) >= 4 and not x.lower().startswith(("ogłoszenia o", "wyniki naborów", "wróć"))), None)
    named_by = "kprm.detail.header"
    if not firm and page.find("title") and title:
        named_by = "kprm.document_title"
        firm = next((p for p in map(str.strip, page.find("title").text().split("|")[1:]) if p and p.casefold() != title.text().casefold() and "praca w służbie cywilnej" not in p.casefold()), None)
    if not title or not title.text() or not number or not firm:
        return []
    path = [p for p in unquote(urlsplit(url).path).split("/") if p]
    return [_row("kprm", number, url, title.text(), firm, named_by, 0.99, city=path[1].replace("-", " ").title() if len(path) > 1 else None, description="\n".join(seen), published_at=f"{m[4]}-{m[3]}-{m[2]}" if m else None)]


# ---- pages of labelled values ----


def after_label(seen: list[str], label: str) -> str | None:
    """The value within three lines of a label, unless another label comes first."""
    for i, line in enumerate(seen):
        if line.casefold() == label.casefold():
            for value in seen[i + 1 : i + 4]:
                if value.endswith(":"):
                    break
                return value
    return None


def labelled_posting(url: str, html: str | None) -> list[dict]:
    page = parse(html)
    seen = lines(page)
    title = next((n for n in page.find_all("h1", "h2", "h3") if n.text() and n.text().lower() not in ("ogłoszenia", "praca", "menu")), None)
    number = re.search(r"/(\d+)(?:-[^/]*)?/?$", urlsplit(url).path)
    firm = after_label(seen, "Ogłoszeniodawca:")
    if not title or not number or not firm:
        return []
    site = next((a.get("href") for a in page.find_all("a") if a.get("href").startswith(("http://", "https://")) and a.text() and a.text() == after_label(seen, "Strona internetowa:")), None) or after_label(seen, "Strona internetowa:")
    sites = [{"url": site, "source": "ngo.detail.contact.website", "confidence": 0.9}] if site and site.startswith(("http://", "https://")) else []
    at = seen.index(title.text()) if title.text() in seen else 0
    place = next((x.removesuffix("・").strip() for x in seen[at + 1 : at + 8] if len(x) <= 80 and not x.endswith(":") and not polish_date(x)), None)
    return [_row("ngo", number[1], url, title.text(), firm, "ngo.detail.advertiser", 0.99, company_website_candidates=sites, city=place, description="\n".join(seen), published_at=polish_date("\n".join(seen)))]


# ---- portals with structured data, and what stands in where it is missing ----


@dataclass(frozen=True)
class Structured:
    """A portal whose offers carry structured data; agencies stand in for employers they don't name."""

    offer: str
    published: str
    place: tuple[str, ...] = ()
    firm_links: str = ""
    firm: str = ""
    named_by: str = ""
    confidence: float = 0.0
    website: str = ""


# Offer paths, wordings of dates and places, and the agencies' names.
STRUCTURED = {
    "aplikuj": Structured(r"^/oferta/(\d+)/[^/?#]+/?$", r"\bDodana\s+(\d{1,2}\s+\w+\s+\d{4})", firm_links="a[href*='/pracodawca/']", named_by="aplikuj.detail.employer_link", confidence=0.98),
    "manpower": Structured(r"^/pl/job/(\d+)/[^/?#]+/?$", r"\b(?:oferta\s+opublikowana|posted)\s*:?\s*(\d{1,2}\s+\w+\s+\d{4})", (r"(?:^|\n)(?:Lokalizacja|Location)\s*\n\s*([^\n]+)", r"(?:^|\n)Miejsce\s+pracy\s*:\s*([^\n]+)"), firm="ManpowerGroup Sp. z o.o.", named_by="manpower.agency_fallback", confidence=0.98, website="https://www.manpower.pl/"),
    "randstad": Structured(r"^/znajdz-prace/[^/]+_(\d+)/?$", r"\bopublikowano\s+(\d{1,2}\s+\w+\s+\d{4})", firm="Randstad Polska Sp. z o.o.", named_by="randstad.agency_fallback", confidence=0.35),
}
_NIP = re.compile(r"\bNIP\s*[:\-]?\s*(\d{10})\b", re.I)


def structured_reader(source: str) -> Callable[[str, str | None], list[dict]]:
    """A reader by the rules of one portal."""
    rules = STRUCTURED[source]

    def read(url: str, html: str | None) -> list[dict]:
        page = parse(html)
        number = re.match(rules.offer, urlsplit(url).path, re.I)
        seen = "\n".join(lines(page))
        row = job_posting(url, page, source)
        if row is None:
            title = page.find("h1")
            firm = rules.firm or next((n.text() for n in page.select(rules.firm_links) if n.text()), "")
            if not title or not title.text() or not number or not firm:
                return []
            after = seen.split(title.text(), 1)[-1].strip().split("\n") if source != "manpower" else []
            place = next((x for x in after[:4] if 2 < len(x) <= 60 and not any(c.isdigit() for c in x) and not x.endswith(":")), None)
            sites = [{"url": rules.website, "source": f"{source}.listing_agency.website", "confidence": 1.0}] if rules.website else []
            row = _row(source, number[1], url, title.text(), firm, rules.named_by, rules.confidence, description=seen, city=place, company_website_candidates=sites)
        if number:
            row["source_id"] = number[1]
        elif source != "aplikuj":
            return []
        written = re.search(rules.published, seen, re.I)
        row["published_at"] = row["published_at"] or (polish_date(written[1]) if written else None)
        found = next((m[1].split(",", 1)[0].strip() for p in rules.place if (m := re.search(p, seen, re.I))), None)
        row["city"] = row["city"] or found or None
        nip = _NIP.search(seen) if source == "aplikuj" else None
        if nip and nip[1] not in {i["value"] for i in row["company_identifiers"]}:
            row["company_identifiers"] = [*row["company_identifiers"], {"kind": "nip", "value": nip[1], "source": "aplikuj.detail.recruitment_clause", "confidence": 0.98}]
        return [row]

    return read


# ---- offers embedded as page data ----


def page_data_posting(url: str, html: str | None) -> list[dict]:
    """The offer in the data attribute of a page's root element."""
    root = next((n for n in parse(html).select("#app") if n.get("data-page")), None)
    try:
        offer = _at(json.loads(root.get("data-page")), "props", "offer") if root else None
    except ValueError:
        return []
    school = _at(offer, "rspo")
    said = lambda *paths: next((v for p in paths if (v := _said(_at(offer, *p)))), None)
    number = said(("id",)) or (re.match(r"^/oferty/(\d+)/?$", urlsplit(url).path) or [None, None])[1]
    title = said(("position_category_name",), ("position_category", "name"), ("subject", "name"), ("profession", "name"), ("employee_type", "name"))
    firm = _said(_at(school, "name"))
    if not number or not title or not firm:
        return []
    parts = dict.fromkeys(filter(None, (said((f,)) for f in ("job_description", "requirements", "responsibilities", "offer", "required_documents", "additional_documents", "contact"))))
    site = website_candidate(_said(_at(school, "website")))
    return [_row(
        "ofertypracyedu", number, url, title, firm, "ofertypracyedu.inertia.offer.rspo.name", 0.99, city=said(("rspo", "city"), ("rspo", "post_office"), ("rspo", "commune")), description="\n\n".join(parts) or None, published_at=said(("published_at",)),
        company_website_candidates=[{"url": site[0], "source": "ofertypracyedu.inertia.offer.rspo.website", "confidence": 0.9}] if site else [],
    )]


READERS: dict[str, Callable[[str, str | None], list[dict]]] = {"olx": state_postings, "kprm": announcement_posting, "ngo": labelled_posting, "ofertypracyedu": page_data_posting} | {s: structured_reader(s) for s in STRUCTURED}


def portal_postings(payloads: DataFrame, readers: dict[str, Callable[[str, str | None], list[dict]]] = READERS) -> DataFrame:
    """Postings of recorded pages (source, url, body) of these portals; NULL pages and other sources give none."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [p for s, u, b in zip(f["source"], f["url"], f["body"]) if s in readers and u and b for p in readers[s](u, b)]
            if rows:
                yield pd.DataFrame(rows)

    return payloads.select("source", "url", "body").mapInPandas(run, POSTING)
