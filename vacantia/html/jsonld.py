"""Structured data in pages: job postings and organisations in JSON-LD."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from vacantia.html.dom import Node, parse


def payloads(page: Node) -> Iterator[Any]:
    """Every readable JSON-LD block, in order."""
    for n in page.find_all("script"):
        if n.get("type").lower() == "application/ld+json":
            try:
                yield json.loads(n.raw())
            except ValueError:
                continue


def objects(value: Any) -> Iterator[dict]:
    """All objects within a value, depth first."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from objects(v)
    elif isinstance(value, list):
        for v in value:
            yield from objects(v)


def types(o: dict) -> list[str]:
    t = o.get("@type")
    return [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []


def first_of(page: Node, kind: str) -> dict | None:
    return next((o for p in payloads(page) for o in objects(p) if kind in types(o)), None)


def said(value: Any) -> str | None:
    """A scalar as stripped text."""
    if isinstance(value, (str, int, float)) and not isinstance(value, bool):
        return str(value).strip() or None
    return None


def plain(value: Any) -> str | None:
    """A text that may hold markup or entities, as visible text."""
    t = said(value)
    return (parse(parse(t).text()).text() if "&" in t else parse(t).text()) or None if t else None


# Words in the labels of an organisation's numbers, by kind.
_KINDS = (("nip", ("nip", "vat", "tax")), ("regon", ("regon",)), ("krs", ("krs",)))


def identifiers(org: dict) -> list[dict]:
    """Numbers of an organisation: nip, regon, krs or organization_id, by what their labels say."""
    out = []
    for key in ("taxID", "vatID"):
        if said(org.get(key)):
            out.append({"kind": "nip", "value": said(org[key]), "source": f"jsonld.hiringOrganization.{key}", "confidence": 0.95})
    held = org.get("identifier")
    for item in held if isinstance(held, list) else [held]:
        label, value = ("", said(item)) if not isinstance(item, dict) else (" ".join(filter(None, (said(item.get(k)) for k in ("name", "propertyID", "@type")))).lower(), said(item.get("value")))
        if value:
            kind = next((k for k, words in _KINDS if any(w in label for w in words)), "organization_id")
            out.append({"kind": kind, "value": value, "source": "jsonld.hiringOrganization.identifier", "confidence": 0.95})
    return [x for i, x in enumerate(out) if (x["kind"], x["value"]) not in {(y["kind"], y["value"]) for y in out[:i]}]


def websites(org: dict) -> list[dict]:
    same = org.get("sameAs")
    urls = [said(org.get("url")), *[said(u) for u in (same if isinstance(same, list) else [same])]]
    return [{"url": u, "source": "jsonld.hiringOrganization", "confidence": 0.9} for u in dict.fromkeys(filter(None, urls))]


def city(posting: dict) -> str | None:
    """The first locality named, else the first region or country, else Remote where it says so."""
    held = posting.get("jobLocation")
    addresses = [loc.get("address", loc) for loc in (held if isinstance(held, list) else [held]) if isinstance(loc, dict)]
    for keys in (("addressLocality",), ("addressRegion", "addressCountry")):
        for a in addresses:
            for k in keys:
                v = a.get(k) if isinstance(a, dict) else None
                v = plain(v.get("name") if isinstance(v, dict) else v)
                if v:
                    return v
    return "Remote" if str(posting.get("jobLocationType") or "").upper() == "TELECOMMUTE" else None


def job_posting(url: str, page: Node, source: str) -> dict | None:
    """The posting a page describes, or None without a title and a firm."""
    p = first_of(page, "JobPosting")
    org = p.get("hiringOrganization") if p else None
    if not p or not isinstance(org, dict) or not plain(p.get("title")) or not plain(org.get("name")):
        return None
    ident = p.get("identifier")
    own = said(ident.get("value")) if isinstance(ident, dict) else said(ident)
    return {
        "source": source, "source_id": own or url, "url": url, "title": plain(p["title"]), "company_name": plain(org["name"]), "company_name_source": "jsonld.hiringOrganization.name", "company_name_confidence": 0.99,
        "company_identifiers": identifiers(org), "company_website_candidates": websites(org), "city": city(p), "description": plain(p.get("description")), "published_at": said(p.get("datePosted")), "refreshed_at": None,
    }
