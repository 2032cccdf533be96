"""Canonical addresses and hosts."""

from __future__ import annotations

from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Query keys that only track visitors.
TRACKING_KEYS = frozenset(("dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "yclid", "_ga", "_gl"))
DEFAULT_PORTS = {"http": 80, "https": 443}


def canonical_url(value: str | None, base: str | None = None) -> str | None:
    """A stable http(s) address: resolved, lower-case host, no fragment, default port or tracking keys."""
    if not value or not value.strip():
        return None
    try:
        parts = urlsplit(urldefrag(urljoin(base, value.strip()) if base else value.strip())[0])
        port = parts.port
    except ValueError:
        return None
    host = (parts.hostname or "").strip().rstrip(".").lower()
    scheme = parts.scheme.lower()
    if scheme not in DEFAULT_PORTS or not host or parts.username is not None or parts.password is not None:
        return None
    shown = f"[{host}]" if ":" in host else host
    place = shown if port in (None, DEFAULT_PORTS[scheme]) else f"{shown}:{port}"
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not (k.strip().lower() in TRACKING_KEYS or k.strip().lower().startswith("utm_"))]
    return urlunsplit((scheme, place, parts.path, urlencode(kept, doseq=True), ""))


@F.pandas_udf(StringType())
def canonical_urls(values: pd.Series) -> pd.Series:
    known = {v: canonical_url(v) for v in values.dropna().unique()}
    return pd.Series([known.get(v) for v in values], dtype=object)


@F.pandas_udf(StringType())
def resolved_urls(values: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([canonical_url(v, b) for v, b in zip(values, bases)], dtype=object)


def host_of(url: Column) -> Column:
    """Lower-case host without `www.`, user or port; NULL where the address has none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(authority), r"^www\.|\.$", ""), F.lit(""))


def website_candidate(raw: str | None) -> tuple[str, str] | None:
    """(address, host) of a candidate for a firm's website: https by default, a host with a dot, no blanks."""
    value = (raw or "").strip()
    if not value or any(c.isspace() for c in value):
        return None
    try:
        parts = urlsplit(value if "://" in value else f"https://{value}")
        host = (parts.hostname or "").lower().removeprefix("www.")
    except ValueError:
        return None
    if parts.scheme not in DEFAULT_PORTS or "." not in host:
        return None
    return urlunsplit((parts.scheme, parts.netloc, parts.path, parts.query, "")), host


@F.pandas_udf(StructType([StructField("url", StringType()), StructField("host", StringType())]))
def website_candidates(values: pd.Series) -> pd.DataFrame:
    found = {v: website_candidate(v) or (None, None) for v in values.dropna().unique()}
    return pd.DataFrame([found.get(v, (None, None)) for v in values], columns=["url", "host"])


def profile_identifier(value: str) -> str | None:
    """An employer's profile address without query, fragment and closing slash, or folded free text."""
    parts = urlsplit(value.strip())
    if parts.scheme.lower() not in DEFAULT_PORTS or not parts.hostname:
        text = " ".join(value.casefold().split())
        return text if len(text) > 1 else None
    port = f":{parts.port}" if parts.port is not None else ""
    return urlunsplit((parts.scheme.lower(), parts.hostname.rstrip(".") + port, parts.path.rstrip("/") or "/", "", ""))
