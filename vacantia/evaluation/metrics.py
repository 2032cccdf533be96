"""Measures of predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.rounding import ratio

#: A label that takes a row out of every measure.
EXCLUDED = "__exclude__"


def confusion(rows: DataFrame, truth: Column, predicted: Column, classes: list[str]) -> DataFrame:
    """Counts of every pair of classes, zeros included."""
    grid = rows.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "truth string, predicted string")
    got = rows.select(truth.alias("truth"), predicted.alias("predicted")).groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return grid.join(got, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class of a confusion matrix, unrounded."""
    hits = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    t = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(hits).alias("hits"))
    p = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    out = t.join(p, "class").select("*", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")))


def pairwise(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Precision, recall and F1 over all pairs of rows, from the contingency table.

    n rows of a cell make n(n-1)/2 pairs that truth and prediction both put together; no pair is made.
    """
    cells = rows.select(truth.alias("t"), predicted.alias("p")).dropna().groupBy("t", "p").agg(F.count("*").alias("n"))
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("bigint")
    both = cells.agg(F.coalesce(F.sum(pairs("n")), F.lit(0)).alias("both"))
    t = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0)).alias("in_truth"))
    p = cells.groupBy("p").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0)).alias("in_prediction"))
    one = both.withColumn("k", F.lit(1)).join(t.withColumn("k", F.lit(1)), "k").join(p.withColumn("k", F.lit(1)), "k").drop("k")
    return one.select("*", ratio(F.col("both"), F.col("in_prediction")).alias("precision"), ratio(F.col("both"), F.col("in_truth")).alias("recall"), ratio(2 * F.col("both"), F.col("in_truth") + F.col("in_prediction")).alias("f1"))


def domain_outcomes(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """TP, FP, FN, TN and wrong domains; a wrong domain is a false positive and a false negative."""
    right = truth.eqNullSafe(predicted)
    wrong = truth.isNotNull() & predicted.isNotNull() & ~right
    g = rows.agg(
        F.count_if(right & truth.isNotNull()).alias("tp"), F.count_if(predicted.isNotNull() & ~right).alias("fp"), F.count_if(truth.isNotNull() & ~right).alias("fn"),
        F.count_if(truth.isNull() & predicted.isNull()).alias("tn"), F.count_if(wrong).alias("wrong_domain"),
    )
    return g.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def label_status(rows: DataFrame, label: Column, classes: list[str]) -> DataFrame:
    """How many labels are given, blank, excluded or of no class."""
    value = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    blank, excluded = value == "", value == EXCLUDED
    return rows.agg(
        F.count("*").alias("total"), F.count_if(blank).alias("blank"), F.count_if(excluded).alias("excluded"), F.count_if(value.isin(*classes)).alias("labelled"), F.count_if(~blank & ~excluded & ~value.isin(*classes)).alias("invalid"),
    )
