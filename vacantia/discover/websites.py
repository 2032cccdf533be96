"""Ranking search results for a firm's website and confirming a site by its own pages.

Ranking is native: word arrays and their intersections. Confirmation gathers a site's few crawled pages
per attempt (a crawl has a page cap) and weighs them natively too; only reading the pages into
text and structured data is Python, in Arrow batches before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.text import firm_names, fold_text, folded
from vacantia.functions.urls import host_of, website_candidate
from vacantia.html.dom import parse
from vacantia.html.jsonld import objects, payloads, said, types

# Hosts that are never a firm's own, and words that say nothing of a firm.
BLOCKED_HOSTS = ("facebook.com", "linkedin.com", "instagram.com", "youtube.com", "olx.pl", "pracuj.pl", "indeed.com", "indeed.pl", "gowork.pl", "jooble.org")
STOP_WORDS = ("sp", "z", "oo", "sa", "s", "a", "polska", "firma", "group", "grupa")
# Words too general to confirm a firm by, and types of organisations.
GENERAL = ("firma", "company", "group", "grupa", "polska", "service", "services")
ORGANISATIONS = frozenset("organization corporation localbusiness store restaurant hotel employmentagency".split())
LEAST_SEARCH, LEAST_SITE = 0.45, 0.55
PAGE_CHARS = 200_000


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(folded(text), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def search_score(name: Column, city: Column, title: Column, snippet: Column, url: Column) -> Column:
    """0 to 1: how likely a search result is the firm's own site."""
    host = host_of(url)
    flat = F.regexp_replace(folded(host), " ", "")
    mine, theirs = tokens(name), tokens(F.concat_ws(" ", title, snippet, host))
    blocked = F.exists(F.array(*map(F.lit, BLOCKED_HOSTS)), lambda b: (host == b) | host.endswith(F.concat(F.lit("."), b)))
    in_host = F.exists(mine, lambda w: (F.length(w) >= 4) & F.contains(flat, w)) | F.contains(flat, F.array_join(F.array_sort(mine), ""))
    place = folded(city)
    said_there = folded(F.concat_ws(" ", title, snippet))
    score = (
        0.62 * F.size(F.array_intersect(mine, theirs)) / F.size(mine) + F.when(in_host, 0.20).otherwise(0.0)
        + F.when((F.coalesce(place, F.lit("")) != "") & F.contains(said_there, place), 0.12).otherwise(0.0) + F.when(folded(title).rlike("kontakt|oficjalna|official"), 0.04).otherwise(0.0)
    )
    return F.when(host.isNull() | blocked | (F.size(mine) == 0), 0.0).otherwise(F.least(score, F.lit(1.0)))


def ranked_candidates(found: DataFrame, k: int = 3) -> DataFrame:
    """The k best results of each company at `LEAST_SEARCH` or above (company_id, name, city, title, snippet, url)."""
    s = found.withColumn("score", search_score(*[F.col(c) for c in ("name", "city", "title", "snippet", "url")])).filter(F.col("score") >= LEAST_SEARCH)
    w = Window.partitionBy("company_id").orderBy(F.col("score").desc(), "url")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_READ = "attempt string, text string, names array<string>, hosts array<string>, cities array<string>, tax boolean"


def _read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages to folded text and what their structured data says of organisations."""
    for f in frames:
        rows = []
        for attempt, html in zip(f["attempt"], f["html"]):
            page = parse(html)
            orgs = [o for p in payloads(page) for o in objects(p) if ORGANISATIONS & {t.lower() for t in types(o)}]
            addresses = [a for o in orgs for a in (o["address"] if isinstance(o.get("address"), list) else [o.get("address")]) if isinstance(a, dict)]
            links = [u for o in orgs for u in [o.get("url"), *(o["sameAs"] if isinstance(o.get("sameAs"), list) else [o.get("sameAs")])] if said(u)]
            rows.append((
                attempt, fold_text(page.text()[:PAGE_CHARS]), [n for o in orgs for k in ("name", "legalName") if (n := said(o.get(k)))], [c[1] for u in links if (c := website_candidate(said(u)))],
                [fold_text(c) for a in addresses if (c := said(a.get("addressLocality")))], any(said(o.get(k)) for o in orgs for k in ("taxID", "vatID")),
            ))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])


def confirm(attempts: DataFrame, pages: DataFrame, least: float = LEAST_SITE) -> DataFrame:
    """attempt, content_score, score, coverage, accepted and signals of every attempt.

    `attempts`: attempt, name, city, url, search_score; `pages`: attempt, html. Attempts without pages
    score 0.35 of their search score and are not accepted. NULL cities and pages say nothing.
    """
    read = pages.filter("html is not null").select("attempt", "html").mapInPandas(_read, _READ)
    names = read.select("attempt", F.explode("names").alias("n")).select("attempt", firm_names("n").alias("n"))
    g = read.groupBy("attempt").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"), F.flatten(F.collect_list("hosts")).alias("hosts"), F.flatten(F.collect_list("cities")).alias("cities"), F.max("tax").alias("tax"))
    g = g.join(names.groupBy("attempt").agg(F.collect_set("n").alias("names")), "attempt", "left")
    a = attempts.withColumn("own", firm_names("name")).join(g, "attempt", "left")
    words = F.filter(F.array_distinct(F.split("own", " ")), lambda w: (F.length(w) >= 3) & ~w.isin(*GENERAL))
    a = a.withColumn("mine", F.when(F.size(words) > 0, words).otherwise(F.filter(F.array_distinct(F.split("own", " ")), lambda w: F.length(w) >= 2)))
    a = a.withColumn("coverage", F.when(F.size("mine") > 0, F.size(F.array_intersect("mine", F.array_distinct(F.split("text", " ")))) / F.size("mine")).otherwise(0.0))
    host = host_of(F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url"))))
    flat, place = F.regexp_replace(folded(host), " ", ""), folded(F.col("city"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    no_names = F.array().cast("array<string>")
    signs = {
        "exact_name": (0.48, yes((F.col("own") != "") & F.contains("text", "own"))), "name_in_host": (0.12, yes(F.exists("mine", lambda w: (F.length(w) >= 4) & F.contains(flat, w)))), "city": (0.06, yes((place != "") & F.contains(F.col("text"), place))),
        "structured_name": (0.20, yes(F.exists(F.coalesce("names", no_names), lambda n: (n != "") & ((n == F.col("own")) | ((F.size("mine") > 0) & (F.size(F.array_intersect("mine", F.split(n, " "))) >= 0.8 * F.size("mine"))))))),
        "structured_host": (0.05, yes(F.array_contains(F.coalesce("hosts", no_names), host))), "structured_city": (0.03, yes((place != "") & F.array_contains(F.coalesce("cities", no_names), place))),
    }
    for name, (_, test) in signs.items():
        a = a.withColumn(f"_{name}", test)
    content = sum((F.when(F.col(f"_{n}"), w).otherwise(0.0) for n, (w, _) in signs.items()), 0.34 * F.col("coverage"))
    seen = F.col("text").isNotNull()
    a = a.withColumn("content_score", F.when(seen, F.least(content, F.lit(1.0))).otherwise(0.0))
    a = a.withColumn("score", F.when(seen, F.least(0.42 * F.col("search_score") + 0.58 * F.col("content_score"), F.lit(1.0))).otherwise(0.35 * F.col("search_score")))
    strong = F.col("_exact_name") | F.col("_structured_name") | (F.col("coverage") >= 0.7) | (F.col("_name_in_host") & (F.col("coverage") >= 0.5))
    signals = F.array_compact(F.array(*[F.when(F.col(f"_{n}"), n) for n in signs], F.when(yes(F.col("tax")), "tax_number"), F.when(~seen, "no_pages")))
    return a.select("attempt", "content_score", "score", F.when(seen, F.col("coverage")).otherwise(0.0).alias("coverage"), (seen & strong & (F.col("score") >= least)).alias("accepted"), signals.alias("signals"))
