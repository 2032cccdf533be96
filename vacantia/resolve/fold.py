"""Order-dependent resolution of postings to firms, folded over parts that can't influence each other.

Every posting sees the firms that earlier postings made, so the fold is sequential; but two postings
interact only if they share a normalised name or a strong identifier. Without strong identifiers the
parts are the names; with them they are the connected parts of the graph of names and identifiers,
found by minimum labels over its distinct edges. Each part folds in one task, in the order of `seq`.

Parts are sorted within their partitions and streamed, so the fold keeps the firms of one part, never
its postings; per posting the work is a lookup by name and city.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.text import firm_names, folded
from vacantia.resolve.decide import Firm, decide, fallback_key
from vacantia.session import cut

RESOLVED = "seq bigint, source string, source_id string, company_seq bigint, created boolean, method string, confidence double, company_key string"


class Fold:
    """The firms of one part, and how each next posting changes them."""

    def __init__(self) -> None:
        self.by_key: dict[str, Firm] = {}
        self.by_name: dict[str, list[Firm]] = {}

    def step(self, seq: int, name: str, shown: str, city: str | None, city_shown: str | None, confidence: float, source: str, source_id: str, named_by: str | None, strong: str | None) -> tuple[int, bool, str, float, str]:
        firm, method, sure = decide(name, city, confidence, self.by_name.get(name, []))
        created = False
        if firm is None:
            key = fallback_key(name, city, bool(city_shown), source, source_id, method, strong)
            firm = self.by_key.get(key)
            if firm is not None:
                method, sure = "stable_source_key", confidence
            else:
                firm = Firm(seq, key, name, shown, city, city_shown, named_by, confidence)
                self.by_key[key] = firm
                self.by_name.setdefault(name, []).append(firm)
                created = True
        if confidence > firm.confidence:
            firm.shown, firm.source, firm.confidence = shown, named_by, confidence
        if firm.city is None:
            firm.city = city
        if firm.city_shown is None:
            firm.city_shown = city_shown
        return firm.seq, created, method, sure, firm.key


def prepared(postings: DataFrame, seq: str = "id", strong: str | None = None) -> DataFrame:
    """The columns the fold reads. Postings without a name or source are left out."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return postings.filter("company_name_raw is not null and source is not null").select(
        F.col(seq).cast("bigint").alias("seq"), "source", F.coalesce("source_id", "url", F.lit("")).alias("source_id"), firm_names("company_name_raw").alias("name"), F.col("company_name_raw").alias("shown"),
        F.nullif(folded(F.col("city")), F.lit("")).alias("city"), text("city").alias("city_shown"), F.coalesce(F.col("company_name_confidence"), F.lit(0.0)).alias("confidence"), F.col("company_name_source").alias("named_by"),
        (F.col(strong) if strong else F.lit(None).cast("string")).alias("strong"),
    )


def parts(rows: DataFrame) -> DataFrame:
    """name, part: names that strong identifiers connect, over any number of steps, share a part.

    A part is the least name of it that is known; after each round a name takes the part of its part, so the rounds grow
    with the logarithm of the longest chain.
    """
    edges = cut(rows.filter("strong is not null").select("name", "strong").distinct())
    label = cut(rows.select("name").distinct().withColumn("part", F.col("name")))
    while True:
        least = edges.join(label, "name").groupBy("strong").agg(F.min("part").alias("least"))
        new = edges.join(least, "strong").groupBy("name").agg(F.min("least").alias("least"))
        nxt = cut(label.join(new, "name", "left").select("name", F.least("part", F.coalesce("least", "part")).alias("part"), (F.col("least") < F.col("part")).alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nxt.select("name", "part")
        above = nxt.select(F.col("name").alias("part"), F.col("part").alias("up"))
        label = nxt.select("name", "part").join(above, "part", "left").select("name", F.coalesce("up", "part").alias("part"))


def _fold_sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by part and seq, streamed: only the firms of the current part are held."""
    part, state = None, Fold()
    for f in frames:
        f = f.astype(object).where(f.notna(), None)
        out = []
        for r in f[["part", "seq", "source", "source_id", "name", "shown", "city", "city_shown", "confidence", "named_by", "strong"]].itertuples(index=False, name=None):
            if r[0] != part:
                part, state = r[0], Fold()
            _, seq, source, source_id, name, shown, city, city_shown, confidence, named_by, strong = r
            out.append((seq, source, source_id, *state.step(seq, name, shown, city, city_shown, float(confidence), source, source_id, named_by, strong)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESOLVED.split(", ")])


def resolve(postings: DataFrame, seq: str = "id", strong: str | None = None) -> DataFrame:
    """Per posting the firm it belongs to (by the seq of the posting that made it), method and confidence.

    An empty table gives no rows; `seq` must be a total order.
    """
    rows = prepared(postings, seq, strong)
    if strong:
        rows = rows.join(parts(rows), "name")
    else:
        rows = rows.withColumn("part", F.col("name"))

    return rows.repartition("part").sortWithinPartitions("part", "seq").mapInPandas(_fold_sorted, RESOLVED)


def firm_ids(resolved: DataFrame) -> DataFrame:
    """company_seq, company_id: dense numbers in the order in which the firms were made."""
    made = resolved.filter("created").select("company_seq").distinct()
    ranks = made.repartitionByRange(F.col("company_seq")).sortWithinPartitions("company_seq").withColumn("p", F.spark_partition_id())
    ranks = cut(ranks)
    sizes = cut(ranks.groupBy("p").agg(F.count("*").alias("n")))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("p").orderBy("company_seq")
    return ranks.join(F.broadcast(before), "p").select("company_seq", (F.row_number().over(w) + F.col("before")).cast("bigint").alias("company_id"))
