"""How far sources carry the same postings, by fingerprints of firm, title and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.rounding import ratio
from vacantia.functions.text import folded, without_legal_forms


def fingerprint(firm: Column, title: Column, city: Column) -> Column:
    """One text of the normalised parts; NULL where firm or title is empty."""
    f, t = without_legal_forms(folded(firm)), folded(title)
    return F.when((f != "") & (t != ""), F.concat_ws("|", f, t, F.coalesce(folded(city), F.lit(""))))


def source_fingerprints(postings: DataFrame) -> DataFrame:
    """Distinct (source, fp), sources in lower case."""
    # distinct before the filter: the filter then reads the grouped values, and nothing is normalised twice
    fp = postings.select(F.lower(F.trim("source")).alias("source"), fingerprint(F.col("company_name_raw"), F.col("title"), F.col("city")).alias("fp")).groupBy("source", "fp").agg(F.count("*").alias("n"))
    return fp.filter("n > 0 and source is not null and fp is not null").select("source", "fp")


def by_source(fps: DataFrame) -> DataFrame:
    """Per source its fingerprints, how many of them no other source has, and that share."""
    per = fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("source").alias("only"))
    own = per.filter("n = 1").groupBy(F.col("only").alias("source")).agg(F.count("*").alias("exclusive"))
    all_ = fps.groupBy("source").agg(F.count("*").alias("fingerprints"))
    out = all_.join(own, "source", "left").withColumn("exclusive", F.coalesce("exclusive", F.lit(0)))
    return out.select("source", "fingerprints", "exclusive", (F.col("fingerprints") - F.col("exclusive")).alias("shared"), ratio(F.col("exclusive"), F.col("fingerprints")).alias("exclusive_rate"))


def pairwise(fps: DataFrame) -> DataFrame:
    """Every unordered pair of sources with the fingerprints both have, Jaccard and both one-way shares.

    The pairs come from the fingerprints' source lists (a few sources each); pairs without a
    shared fingerprint are filled in from the list of sources, which is small by nature.
    """
    lists = fps.groupBy("fp").agg(F.sort_array(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    each = lists.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    shared = each.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    sizes = fps.groupBy("source").agg(F.count("*").alias("n"))
    names = sizes.agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"))
    pairs = names.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["source"] > a["source"]), lambda b: F.struct(a["source"].alias("a"), a["n"].alias("na"), b["source"].alias("b"), b["n"].alias("nb")))))).alias("p")).select("p.*")
    out = pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return out.select(F.col("a").alias("source_a"), F.col("b").alias("source_b"), "shared", ratio(F.col("shared"), union).alias("jaccard"), ratio(F.col("shared"), F.col("na")).alias("share_of_a"), ratio(F.col("shared"), F.col("nb")).alias("share_of_b"))
