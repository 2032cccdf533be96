"""Employers' profiles on portals: which link of an offer leads to one, and which website it states.

A portal is a row of rules. Profile links count only if their path has the portal's shape and, where the
portal asks for it, their label is the firm's name or the portal's own wording. A website counts
where the portal states it: in a labelled field, in embedded data that is also rendered as a link, or as
the first link that leaves the portal.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from vacantia.functions.urls import canonical_url
from vacantia.html.dom import Node, parse


@dataclass(frozen=True)
class ProfileRules:
    """`path` matches profile addresses; `stated` is how the website is stated: field, embedded or first."""

    hosts: tuple[str, ...]
    path: str
    stated: str
    named_by: str
    confidence: float
    call: str = ""
    any_link: bool = True
    fields: tuple[str, ...] = ()
    foreign: tuple[str, ...] = ()


# portals' profile paths, wordings, field labels and hosts that are no employer's.
PROFILES = {
    "rocketjobs": ProfileRules(("rocketjobs.pl", "rocketjobs.com", "justjoin.it"), r"^/brands/story/[^/]+", "embedded", "rocketjobs.employer_profile.social_media.website", 0.98, call="zobacz profil firmy", any_link=False),
    "karierawfinansach": ProfileRules(("karierawfinansach.pl",), r"^/pracodawca/", "first", "karierawfinansach.employer_profile.website", 0.95, foreign=(
        "facebook.com", "linkedin.com", "youtube.com", "instagram.com", "x.com", "twitter.com", "play.google.com", "apps.apple.com", "itunes.apple.com", "grupambe.pl", "careersinpoland.com", "techkariera.pl", "googletagmanager.com",
    )),
    "skillshot": ProfileRules(("skillshot.pl",), r"^/users/\d+/?$", "field", "skillshot.employer_profile.web_page", 0.97, fields=("strona:", "strona internetowa:", "strona www:", "web page:", "website:")),
}
_EMBEDDED = re.compile(r'"link":"(https?://[^"<>]+)","type":"Website"', re.I)


def _label(text: str) -> str:
    return " ".join(text.casefold().split())


def _of_portal(rules: ProfileRules, host: str) -> bool:
    return any(host == h or host.endswith(f".{h}") for h in rules.hosts)


def _links(page: Node, base: str) -> Iterator[tuple[Node, str, str]]:
    for a in page.find_all("a"):
        u = canonical_url(a.get("href"), base) if a.get("href") else None
        if u:
            yield a, u, urlsplit(u).hostname or ""


def profile_link(rules: ProfileRules, url: str, html: str | None, firm: str) -> str | None:
    """The profile of an offer's employer."""
    found = [(u.split("?")[0], _label(a.text())) for a, u, host in _links(parse(html), url) if _of_portal(rules, host) and re.match(rules.path, urlsplit(u).path)]
    for wanted in filter(None, (rules.call, _label(firm))):
        hit = next((u for u, label in found if label == wanted), None)
        if hit:
            return hit
    return found[0][0] if found and rules.any_link else None


def profile_website(rules: ProfileRules, url: str, html: str | None) -> str | None:
    """The website that an employer's profile states."""
    outside = [(a, u, host) for a, u, host in _links(parse(html), url) if not _of_portal(rules, host)]
    if rules.stated == "embedded":
        rendered = {u for _, u, _ in outside}
        return next((c for m in _EMBEDDED.finditer(markup.unescape(html or "").replace("\\", "")) if (c := canonical_url(m[1])) in rendered), None)
    if rules.stated == "first":
        return next((u for _, u, host in outside if host.removeprefix("www.") not in rules.foreign), None)
    for a, u, _ in outside:
        around = next((n for n in a.up() if n.tag in ("p", "li", "td", "dd")), a.parent)
        if around is not None and _label(around.text()).startswith(rules.fields):
            return u
    return None


def profile_links(offers: DataFrame) -> DataFrame:
    """source, url, profile_url of offers (source, url, body, company_name) that lead to a profile."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, u, p) for s, u, b, c in zip(f["source"], f["url"], f["body"], f["company_name"]) if s in PROFILES and u and (p := profile_link(PROFILES[s], u, b, c or ""))]
            yield pd.DataFrame(rows, columns=["source", "url", "profile_url"])

    return offers.select("source", "url", "body", "company_name").mapInPandas(run, "source string, url string, profile_url string")


def profile_websites(profiles: DataFrame) -> DataFrame:
    """source, profile_url, website, named_by, confidence of profile pages (source, url, body), each profile once."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, u, w, PROFILES[s].named_by, PROFILES[s].confidence) for s, u, b in zip(f["source"], f["url"], f["body"]) if s in PROFILES and u and (w := profile_website(PROFILES[s], u, b))]
            yield pd.DataFrame(rows, columns=["source", "profile_url", "website", "named_by", "confidence"])

    return profiles.select("source", "url", "body").dropDuplicates(["source", "url"]).mapInPandas(run, "source string, profile_url string, website string, named_by string, confidence double")
