"""Pairs of firms that a person should look at: blocked, scored, never merged.

Firms meet under keys of their names (words, first and last letters) and confirmed websites. All pairs
of a key are proposed, each under the first key that both firms have, so pairs are never made twice and never
shuffled; the firms of a key under which more than `BLOCK` stand are dealt to the cells of a square. Where
pairs meet to be scored, those are left out whose score couldn't reach the least one, by bounds of letters and
words that never leave out a pair that does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.resolve.decide import is_distinctive
from vacantia.functions.urls import host_of
from vacantia.session import cut

BLOCK = 200
#: Keys of most firms whose sets are kept as bits of a number.
HOT = 63
LEAST = 0.82
SURE_SITE, SURE_IDENTITY = 0.8, 0.8


def keys_of(firms: DataFrame) -> DataFrame:
    """id, key, city, start of every firm (id, name, city, website_url, website_confidence)."""
    compact = F.regexp_replace("name", " ", "")
    words = F.transform(F.filter(F.split("name", " "), lambda w: F.length(w) >= 4), lambda w: F.concat(F.lit("token:"), w))
    ends = F.when(F.length(compact) >= 6, F.array(F.concat(F.lit("prefix:"), F.substring(compact, 1, 4)), F.concat(F.lit("suffix:"), F.substring(compact, -4, 4)))).otherwise(F.array().cast("array<string>"))
    site = F.when(F.col("website_confidence") >= SURE_SITE, F.array(F.concat(F.lit("website:"), host_of(F.col("website_url"))))).otherwise(F.array().cast("array<string>"))
    return firms.select("id", F.coalesce("city", F.lit("")).alias("city"), F.substring(compact, 1, 3).alias("start"), F.explode(F.array_compact(F.array_distinct(F.concat(words, ends, site)))).alias("key"))


def _dealt_keys(firms: DataFrame, block: int) -> DataFrame:
    """id, at, hot, before, rest, cell of every firm and key under which another firm stands, for `_met`.

    Keys are numbered (`at`), those of most firms first. `hot` has a bit for each of the first `HOT` keys that the firm has,
    `before` the bits of those ahead of this key; `rest` are the other keys ahead of it. A key of over `block` firms is a
    square of cells: a firm stands in one row of it as the first of a pair and in all columns as the second.
    """
    k = keys_of(firms).filter("id is not null").select("id", "key").distinct()
    counts = cut(k.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "key").select("key", F.monotonically_increasing_id().alias("at"), F.ceil(F.sqrt(F.col("n") / block)).cast("int").alias("cells")))
    first = [r["at"] for r in counts.select("at").orderBy("at").limit(HOT).collect()]
    ranks = F.lit(first or [-1]).cast("array<bigint>")
    mine = k.join(counts, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "cells"))).alias("keys"))
    bits = F.lit([1 << i for i in range(HOT)]).cast("array<bigint>")
    bit = lambda x: F.element_at(bits, F.array_position(ranks, x["at"]).cast("int"))
    is_hot = lambda x: x["at"] <= F.lit(first[-1] if first else -1)
    mine = mine.withColumn("hot", F.aggregate(F.filter("keys", is_hot), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(bit(x)))).withColumn("cold", F.transform(F.filter("keys", lambda x: ~is_hot(x)), lambda x: x["at"]))
    each = mine.select("id", "hot", "cold", F.explode("keys").alias("k"))
    before = F.when(is_hot(F.col("k")), bit(F.col("k")) - 1).otherwise(F.lit(-1))
    return each.select("id", F.col("k.at").alias("at"), "hot", before.alias("before"), F.filter("cold", lambda c: c < F.col("k.at")).alias("rest"), F.col("k.cells").alias("cells"))


def _met(dealt: DataFrame, extra: list[str] = [], also: Column | None = None) -> DataFrame:
    """a, b of the firms that meet under the first key that both have, and so once; `also` is asked of both besides."""
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.sparkSession.sparkContext.defaultParallelism)
    cols = ["id", "hot", "before", "rest", *extra]
    own = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    a = dealt.withColumn("row", own).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    b = dealt.withColumn("column", own).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    # a number of tasks of its own: a cell of a few bytes makes many pairs
    a, b = (x.select("at", "row", "column", *cols).repartition(tasks, "at", "row", "column").alias(s) for x, s in ((a, "a"), (b, "b")))
    on = (F.col("a.at") == F.col("b.at")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.column") == F.col("b.column")) & (F.col("a.id") < F.col("b.id"))
    on = on & (F.col("a.hot").bitwiseAND(F.col("b.hot")).bitwiseAND(F.col("a.before")) == 0)
    on = on & ((F.size("a.rest") == 0) | (F.size("b.rest") == 0) | ~F.arrays_overlap("a.rest", "b.rest"))
    return a.join(b.hint("merge"), on if also is None else on & also)


def blocked_pairs(firms: DataFrame, block: int = BLOCK) -> DataFrame:
    """id_a < id_b of firms that share a key, each pair once: nothing but the keys is shuffled, never the pairs."""
    return _met(_dealt_keys(firms, block)).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def _score(name: Column, tokens: Column, place: Column, site: Column, sure: Column, weak: Column) -> Column:
    base = 0.72 * name + 0.28 * tokens + F.when(place, 0.04).otherwise(0.0)
    base = F.when(site, F.greatest(base + 0.15, F.lit(0.9))).otherwise(base)
    base = base + F.when(sure, 0.02).otherwise(0.0) - F.when(weak, 0.08).otherwise(0.0)
    return F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0))


def _reduced(firms: DataFrame) -> DataFrame:
    """id and what `_may_score` asks of a firm: numbers alone, whatever the length of its name.

    `some` and `more` have for each of 32 groups of letters a bit for the first to fourth letter of it in the name, `words`
    one for each word by its hash.
    """
    bits = F.lit([1 << i if i < 63 else -(1 << 63) for i in range(64)]).cast("array<bigint>")
    none = F.lit(0).cast("bigint")

    def raised(held: Column, low: Column, high: Column) -> Column:
        return held.bitwiseOR(low).bitwiseOR(F.when(held.bitwiseAND(low) != 0, high).otherwise(none))

    def letter(held: Column, x: Column) -> Column:
        group = F.pmod(F.ascii(x), F.lit(32)) * 2
        low, high = F.element_at(bits, group + 1), F.element_at(bits, group + 2)
        return F.struct(raised(held["some"], low, high).alias("some"), F.when(held["some"].bitwiseAND(high) != 0, raised(held["more"], low, high)).otherwise(held["more"]).alias("more"))

    words = F.array_distinct(F.split("name", " "))
    letters = F.aggregate(F.filter(F.split("name", ""), lambda x: x != ""), F.struct(none.alias("some"), none.alias("more")), letter)
    marks = F.aggregate(words, none, lambda held, w: held.bitwiseOR(F.element_at(bits, F.pmod(F.hash(w), F.lit(64)) + 1)))
    out = firms.select("id", F.length("name").alias("long"), F.size(words).alias("n"), marks.alias("words"), letters.alias("l"), F.when(F.col("city").isNotNull(), F.xxhash64("city")).alias("place"), F.when(F.col("website_confidence") >= SURE_SITE, host_of(F.col("website_url"))).alias("host"), F.coalesce(F.col("confidence") >= SURE_IDENTITY, F.lit(False)).alias("sure"))
    return out.select("id", "long", "n", "words", "l.some", "l.more", "place", F.when(F.col("host").isNotNull(), F.xxhash64("host")).alias("site"), "sure")


def _may_score(least: float) -> Column:
    """Whether firms a and b of `_reduced` can reach `least`: no score is above what is worked out here.

    The blocks that names have in common are letters of both, so a letter that only one has takes from the similarity; a
    word whose bit only one has is no common word.
    """
    a, b = (lambda c, s=s: F.col(f"{s}.{c}") for s in "ab")
    off = F.greatest(F.bit_count(a("some").bitwiseXOR(b("some"))) + F.bit_count(a("more").bitwiseXOR(b("more"))), F.abs(a("long") - b("long")))
    both = a("long") + b("long")
    name = F.when(both > 0, (both - off) / both).otherwise(1.0)
    shared = F.least(a("n") - F.bit_count(a("words").bitwiseAND(F.bitwise_not(b("words")))), b("n") - F.bit_count(b("words").bitwiseAND(F.bitwise_not(a("words")))))
    same = lambda c: F.coalesce(a(c) == b(c), F.lit(False))
    return _score(name, shared / (a("n") + b("n") - shared), same("place"), same("site"), a("sure") & b("sure"), F.lit(False)) >= least - 1e-9


def likely_pairs(firms: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """Those of `blocked_pairs` that can score `least`; what can't is left out where it meets."""
    features = _reduced(firms)
    return _met(_dealt_keys(firms, block).join(features, "id"), features.columns[1:], _may_score(least)).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def similarity(a: str, b: str) -> float:
    """`SequenceMatcher(None, a, b).ratio()`, the blocks looked for by growing the longest one so far."""
    if len(b) >= 200:  # there it leaves frequent letters out
        return SequenceMatcher(None, a, b).ratio()
    total, todo = len(a) + len(b), [(a, b)]
    matched = 0
    while todo:
        x, y = todo.pop()
        size = at = 0
        for i in range(len(x)):
            while i + size < len(x) and x[i : i + size + 1] in y:
                size, at = size + 1, i
            if i + size >= len(x):
                break
        if size:
            matched += size
            to = y.index(x[at : at + size])
            if at and to:
                todo.append((x[:at], y[:to]))
            if at + size < len(x) and to + size < len(y):
                todo.append((x[at + size :], y[to + size :]))
    return 2.0 * matched / total if total else 1.0


def scored_pairs(firms: DataFrame, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """id_a, id_b, score and its parts of the pairs at `least` or above (firms also need confidence)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            name = [1.0 if x == y else similarity(x, y) for x, y in zip(f["name_a"], f["name_b"])]
            weak = [not (is_distinctive(x) and is_distinctive(y)) for x, y in zip(f["name_a"], f["name_b"])]
            yield f.drop(columns=["name_a", "name_b"]).assign(name_similarity=name, weak=weak)

    cols = ["name", "city", "website_url", "website_confidence", "confidence"]
    a, b = (firms.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    j = pairs.join(a, "id_a").join(b, "id_b")
    wa, wb = F.split("name_a", " "), F.split("name_b", " ")
    j = j.withColumn("token_similarity", F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb)))
    place = F.coalesce(F.col("city_a") == F.col("city_b"), F.lit(False))
    site = F.coalesce((host_of(F.col("website_url_a")) == host_of(F.col("website_url_b"))) & (F.col("website_confidence_a") >= SURE_SITE) & (F.col("website_confidence_b") >= SURE_SITE), F.lit(False))
    sure = F.coalesce((F.col("confidence_a") >= SURE_IDENTITY) & (F.col("confidence_b") >= SURE_IDENTITY), F.lit(False))
    j = j.withColumn("same_place", place).withColumn("same_website", site).withColumn("sure", sure)

    def score(name: Column, weak: Column) -> Column:
        return _score(name, F.col("token_similarity"), F.col("same_place"), F.col("same_website"), F.col("sure"), weak)

    la, lb = F.length("name_a"), F.length("name_b")
    most = F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(1.0)
    j = j.filter(score(most, F.lit(False)) >= least - 1e-9).select("id_a", "id_b", "name_a", "name_b", "token_similarity", "same_place", "same_website", "sure")
    out = j.mapInPandas(run, "id_a bigint, id_b bigint, token_similarity double, same_place boolean, same_website boolean, sure boolean, name_similarity double, weak boolean")
    out = out.withColumn("score", score(F.col("name_similarity"), F.col("weak"))).filter(F.col("score") >= least)
    return out.select("id_a", "id_b", "score", "name_similarity", "token_similarity", "same_place", "same_website")
