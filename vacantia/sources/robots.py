"""Offline filter by recorded robots files: which addresses a connector may fetch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "vacantia"


def _parser(status: int | None, body: str | None, strict: bool) -> RobotFileParser | None:
    """The rules of an answer; None where all is forbidden."""
    rules = RobotFileParser()
    if status is None or status >= 400:
        if strict and status != 404 and (status is None or status in (401, 403) or status >= 500):
            return None
        rules.allow_all = True
        return rules
    rules.parse((body or "").splitlines())
    rules.modified()
    return rules


def allowed(urls: DataFrame, robots: DataFrame, agent: str = AGENT, strict: bool = True) -> DataFrame:
    """The rows of `urls` (url, ...) with `may_fetch`, by `robots` (origin, status, body).

    `strict` is the rule of portal readers: no answer, 401, 403 and failures of the server forbid all and 404 allows all. Otherwise,
    as for a crawl of a firm's own site, any failure allows all. Origins without a recorded answer count as no answer. Rules
    are looked up once an origin and batch. Addresses that are none are forbidden.
    """
    origin = F.lower(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1))
    rules = robots.groupBy(F.lower("origin").alias("_origin")).agg(F.max(F.struct("status", "body")).alias("_r"))
    j = urls.withColumn("_origin", origin).join(rules, "_origin", "left").select(*urls.columns, F.col("_origin"), F.col("_r.status").cast("int").alias("_status"), F.col("_r.body").alias("_body"))

    kept = urls.columns

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = {}
            for o, status, body in f[["_origin", "_status", "_body"]].drop_duplicates("_origin").itertuples(index=False):
                made[o] = _parser(None if pd.isna(status) else int(status), body, strict)
            yield f[kept].assign(may_fetch=[bool(o) and made[o] is not None and made[o].can_fetch(agent, u) for o, u in zip(f["_origin"].fillna(""), f["url"])])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in urls.schema.fields)
    return j.mapInPandas(run, f"{fields}, may_fetch boolean")
