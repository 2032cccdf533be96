"""Deterministic stratified samples of exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Joins the parts of a digest.
UNIT = "\u001f"


def digest(seed: str, namespace: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, F.lit(seed), F.lit(namespace), key), 256)


def allocation(strata: DataFrame, limit: int, seed: str) -> DataFrame:
    """stratum, n, take: one row of each stratum first, what is left in proportion by largest remainder.

    Where there are more strata than rows to take, those with the smallest digests get one. Ties of
    remainders go to the smaller digest. All in integers.
    """
    total = Window.partitionBy()
    by_digest = Window.orderBy("d")
    s = strata.withColumn("d", digest(seed, "stratum", F.col("stratum"))).withColumn("all_n", F.sum("n").over(total)).withColumn("k", F.count("*").over(total)).withColumn("rank", F.row_number().over(by_digest))
    want = F.least(F.lit(limit), F.col("all_n"))
    s = s.withColumn("base", F.when(F.col("k") <= want, 1).otherwise((F.col("rank") <= want).cast("int"))).withColumn("rest", F.greatest(want - F.col("k"), F.lit(0))).withColumn("pool", F.col("n") - F.col("base")).withColumn("all_pool", F.sum("pool").over(total))
    s = s.withColumn("share", F.when(F.col("all_pool") > 0, F.expr("(rest * pool) div all_pool")).otherwise(F.lit(0))).withColumn("left_over", F.when(F.col("all_pool") > 0, (F.col("rest") * F.col("pool")) % F.col("all_pool")).otherwise(F.lit(0)))
    s = s.withColumn("missing", F.col("rest") - F.sum("share").over(total)).withColumn("turn", F.row_number().over(Window.orderBy(F.col("left_over").desc(), "d")))
    return s.select("stratum", "n", (F.col("base") + F.col("share") + (F.col("turn") <= F.col("missing")).cast("int")).cast("bigint").alias("take"))


def stratified_sample(rows: DataFrame, key: Column, stratum: Column, limit: int, seed: str) -> DataFrame:
    """The rows with the smallest digests of each stratum, as many as its allocation.

    Only strata and their counts are put in one order; rows are ranked within their stratum after
    the rows that can't be among its first `limit` are left out by an aggregate of digests.
    """
    r = rows.withColumn("_stratum", stratum).withColumn("_digest", digest(seed, "row", key.cast("string")))
    take = allocation(r.groupBy(F.col("_stratum").alias("stratum")).agg(F.count("*").alias("n")), limit, seed)
    w = Window.partitionBy("_stratum").orderBy("_digest")
    ranked = r.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit)
    return ranked.join(take.select(F.col("stratum").alias("_stratum"), "take"), "_stratum").filter(F.col("_rank") <= F.col("take")).drop("_stratum", "_digest", "_rank", "take")
