"""Postings from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.text import blank_to_null
from vacantia.schemas import POSTING_COLUMNS

REQUIRED = ("url", "title", "company_name")


def read_postings_csv(spark: SparkSession, path: str, default_source: str = "csv") -> DataFrame:
    """Postings of a CSV file with a header. Values are trimmed; rows without a required value are dropped.

    A missing source_id becomes row-n with n counted over all rows of the file; confidence defaults to
    1 and the name's source to csv. A header without a required column raises.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = sorted(set(REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"CSV lacks the columns {', '.join(missing)}")
    # one multi-line file is one partition, so the running number within it is the row's number
    numbered = raw.withColumn("_n", F.monotonically_increasing_id() + 1)
    v = {c: blank_to_null(F.col(c)) if c in raw.columns else F.lit(None).cast("string") for c in POSTING_COLUMNS if not c.startswith("company_i") and not c.startswith("company_w")}
    v |= {
        "source": F.coalesce(v["source"], F.lit(default_source)), "source_id": F.coalesce(v["source_id"], F.concat(F.lit("row-"), F.col("_n").cast("string"))),
        "company_name_source": F.coalesce(v["company_name_source"], F.lit("csv")), "company_name_confidence": F.coalesce(v["company_name_confidence"].try_cast("double"), F.lit(1.0)),
        "company_identifiers": F.array().cast("array<struct<kind:string,value:string,source:string,confidence:double>>"), "company_website_candidates": F.array().cast("array<struct<url:string,source:string,confidence:double>>"),
    }
    return numbered.select(*[v[c].alias(c) for c in POSTING_COLUMNS]).dropna(subset=list(REQUIRED))
