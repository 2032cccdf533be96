"""The catalogue of sources: a tab-separated list of portals, and which of them this library reads."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.sources.registry import SOURCES, Source

COLUMNS = ("id", "name", "url", "priority", "type", "public_api", "integration")


def read_catalogue(spark: SparkSession, path: str, readers: Mapping[int, str] | None = None) -> DataFrame:
    """Entries of a catalogue file with trimmed values; `readers` names the source that reads an entry, by its id.

    A file without one of `COLUMNS` raises; an id that is no number gives NULL; entries without a reader are not implemented.
    """
    raw = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = sorted(set(COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"the catalogue lacks the columns {', '.join(missing)}")
    rows = raw.select(F.trim("id").try_cast("int").alias("id"), *[F.trim(c).alias(c) for c in COLUMNS[1:]])
    known = spark.createDataFrame(sorted((readers or {}).items()), "id int, adapter string")
    return rows.join(F.broadcast(known), "id", "left").withColumn("implemented", F.col("adapter").isNotNull())  # one row per source of the registry at most


def chosen(entries: DataFrame, priority: str | None = None, implemented: bool | None = None) -> DataFrame:
    """Entries of a priority (letter case aside), and only those that are or aren't implemented; what isn't given asks for nothing."""
    out = entries
    if priority:
        out = out.filter(F.upper("priority") == priority.strip().upper())
    return out if implemented is None else out.filter(F.col("implemented") == implemented)


def summary(entries: DataFrame) -> DataFrame:
    """priority, entries, implemented; the row without a priority has the totals."""
    return entries.rollup("priority").agg(F.count("*").alias("entries"), F.count_if(F.col("implemented")).alias("implemented"))


def source(name: str) -> Source:
    """A source of the registry; an unknown name raises."""
    try:
        return SOURCES[name.strip().lower()]
    except KeyError:
        raise KeyError(f"unknown source {name}; known are {', '.join(sorted(SOURCES))}") from None


def missing_settings(name: str, env: Mapping[str, str] | None = None) -> list[str]:
    """The settings a connector of the source needs that are unset or blank."""
    env = os.environ if env is None else env
    return [e for e in source(name).env if not env.get(e, "").strip()]


def public_sources() -> list[str]:
    """Sources that are read without any account."""
    return sorted(s.name for s in SOURCES.values() if s.access.startswith(("public", "official_public")))


def same_site(a: Column, b: Column) -> Column:
    """Whether two hosts are one site, `www.` and letter case aside; NULL and empty hosts are none."""
    bare = lambda h: F.regexp_replace(F.lower(F.trim(h)), r"^www\.", "")
    return F.coalesce((bare(a) == bare(b)) & (bare(a) != ""), F.lit(False))
