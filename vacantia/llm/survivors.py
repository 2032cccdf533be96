"""Problem 6: the best representative of each duplicate group, field by field.

The method dealt is skyline selection: of the records of a group those that no other dominates (as complete, trusted, sure and
recent, and better in one) form the first layer, the lexicographic policy picks from it, and what is missing is filled from the
next layers. The policy asked for compares the same things that dominance does, one after the other. Its first record among those that
have a field is therefore dominated by none that has it: whoever dominated it would come before it. So

* each field's survivor lies on the first layer of the records that have the field, whatever the data, and
* no deeper layer ever fills anything.

Layers need not be worked out to be right (a test peels them and compares): per group and field one minimum of the policy's
order over the records that have the field is the layers' result. It combines within tasks before its only shuffle, so a group
with a third of all rows costs as much as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def folded(value: Column) -> Column:
    """Letter case, outer blanks and the sort of joint (`-`, blank or `_`) aside."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[-_\s]+", "_")


def website_host(url: Column) -> Column:
    """The host with a dot that a website address names, without `www.`; NULL for anything else."""
    bare = F.regexp_replace(F.trim(url), r"^(?i:https?:)?//", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?#\s]*)", 1), r":\d*$|\.$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.rlike(r"^[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+$"), host)


def survivors(rows: DataFrame, group: list[str], record: str, trust: str, confidence: str, recency: str, fields: dict[str, str]) -> DataFrame:
    """One row per group of two or more records: the group's columns, first_record and per field its survivor.

    `trust` ascends (NULL last); `confidence` and `recency` descend (NULL last); ties end with the
    smallest record. `fields` maps each result column to the boolean column that says whether the
    record has that field; 0 stands where no record has it. Groups with a NULL column are left out.
    """
    latest = F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(2**62)))
    surest = F.coalesce(F.col(confidence).cast("double"), F.lit(float("-inf")))
    order = F.struct(F.coalesce(F.col(trust).cast("int"), F.lit(2**31 - 1)).alias("trust"), (-surest).alias("sure"), (-latest).alias("late"), F.col(record).alias("id"))
    base = rows.select(*group, F.col(record).alias("_id"), order.alias("_order"), *[F.coalesce(F.col(c), F.lit(False)).alias(f"_has{i}") for i, c in enumerate(fields.values())]).dropna(subset=group)
    picked = base.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_id").alias("first_record"), *[F.min(F.when(F.col(f"_has{i}"), F.col("_order"))).alias(f"_first{i}") for i in range(len(fields))])
    return picked.filter("_n > 1").select(*group, "first_record", *[F.coalesce(F.col(f"_first{i}.id"), F.lit(0)).cast("bigint").alias(name) for i, name in enumerate(fields)])


def company_survivors(companies: DataFrame, source_trust: DataFrame, portals: DataFrame) -> DataFrame:
    """group_id, website_company_id, identity_company_id of each group of companies with equal name and city.

    Any column may be NULL: a NULL name or city puts a row in no group, a NULL or unknown source
    ranks last, and a confidence outside 0..1, NaN or NULL counts as none. Both dimension tables
    are fixed and small; repeated rows of them count once (the best trust). Empty tables give an
    empty result.
    """
    trust = source_trust.groupBy(folded(F.col("identity_source")).alias("_source")).agg(F.min("trust_rank").alias("_rank"))
    hosts = portals.select(website_host(F.col("host")).alias("_host")).dropna().distinct().withColumn("_portal", F.lit(True))
    c = companies.select(
        F.col("id").cast("bigint").alias("_id"), F.col("normalized_name").alias("_name"), F.col("normalized_city").alias("_city"), "updated_at",
        folded(F.col("identity_source")).alias("_source"), F.col("identity_confidence").cast("double").alias("_c"), website_host(F.col("website_url")).alias("_host"),
    ).filter("_name is not null and _city is not null")
    # NaN sorts above every number, so the upper bound excludes it
    c = c.withColumn("_confidence", F.when(F.col("_c").between(0, 1), F.col("_c")))
    c = c.join(trust, "_source", "left").join(hosts, "_host", "left")
    c = c.withColumn("_web", F.col("_host").isNotNull() & F.col("_portal").isNull()).withColumn("_known", F.col("_rank").isNotNull() & F.col("_confidence").isNotNull())
    out = survivors(c, ["_name", "_city"], "_id", "_rank", "_confidence", "updated_at", {"website_company_id": "_web", "identity_company_id": "_known"})
    return out.select(F.col("first_record").alias("group_id"), "website_company_id", "identity_company_id")
