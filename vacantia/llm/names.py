"""Problem 1: linking the variant spellings of one employer.

1. Every spelling of a company row (canonical name, aliases, raw names of its postings, the label of
   its own website) is read into a distinctive core and qualifiers: trade, kind of business,
   first name (`name_parts`). Rows with the same own reading, place and website become one node.
2. Cores become vectors of character n-grams (n = `GRAM`, with the ends marked) weighted by inverse
   document frequency over all cores. A sparse join finds the pairs with a cosine of `COSINE` or more:
   a core is indexed under pairs of its n-grams, the rarest first, until the first and the rest of its vector are shorter than
   `COSINE`, and under single n-grams that have that share alone or where it is long; two cores of that cosine share
   a key and no pair is lost; nothing else but the cosine is asked for.
   All partners above the threshold are kept: a top n of them would drop links. One changed letter takes up to four
   n-grams away, so cores within `TYPOS` edits of each other (swapped neighbours count as one) are found besides by an index
   of deletions (every such pair meets in it, whatever its vector) and linked by the cosine of their `SHORT_GRAM`-grams.
   The words of a core of several are also joined in the order of the alphabet, so reordered names meet, and
   three words or more in their initials.
3. The similarity of two nodes with linked cores is the probability that they are one employer, by how near the cores
   are and whether trades, places, websites, kinds of business and first names agree, differ or are unknown. What each of
   these says is not set but estimated from the candidate pairs themselves, by expectation maximisation of
   a two-class model over the counts of all patterns of agreement (a few hundred, whatever the size of the tables).
   All nodes with linked cores are compared; the nodes of a core that more than `COMMON` of all have are dealt to several tasks.
4. Average linkage: within each connected part of the graph the two nearest clusters merge while the
   mean similarity of their members (0 where there is no link) is `LINK` or more. All pairs of clusters
   that are each other's nearest merge in one round, which gives the same tree; the rounds run over all
   parts of a partition at once, and as joins for a part with more than `PART_EDGES` edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm import core_pairs
from vacantia.llm.name_parts import read_name
from vacantia.llm.places import Resolver, fold, reference_entries
from vacantia.llm.survivors import website_host
from vacantia.llm.union_find import components
from vacantia.session import cut

GRAM, COSINE = 4, 0.6
#: Edits between cores that are compared whatever they share; n-grams and least cosine of those.
TYPOS, SHORT_GRAM, SHORT_COSINE = 2, 2, 0.25
#: Buckets that the document frequencies of n-grams are counted in, by n.
BUCKETS = {SHORT_GRAM: 1 << 11, GRAM: 1 << 15}
#: Cores of more letters are cut into segments instead of losing letters.
DELETION_LETTERS = 40
#: Cores whose keys one task holds.
CORES_A_TASK = 8_000
#: Least mean weight between two clusters that merge; least weight of a pair that is kept as a link.
LINK, LEAST = 0.55, 0.2
#: Most edges of one connected part that is clustered within a task.
PART_EDGES = 200_000
#: Shortest core that tells firms apart.
CORE_LETTERS = 3
#: Share of all nodes (and number of them) from which the nodes of one core are dealt to several tasks.
COMMON, COMMON_NODES = 0.01, 64
#: What a pair of nodes is compared by besides the cores.
FIELDS = ("trades", "place", "host", "forms", "person")
#: How near two cores are: equal, one edit, two, by n-grams alone, initials.
NEARNESS = 5
#: Where the estimate starts, and how many pairs that start counts for: chance of one employer; of agreement in one and in two employers; of each nearness.
START, START_PAIRS = 0.3, 40.0
START_AGREE = {"trades": (0.97, 0.06), "place": (0.9, 0.02), "host": (0.9, 0.001), "forms": (0.95, 0.2), "person": (0.98, 0.05)}
START_NEAR = ((0.8, 0.12, 0.05, 0.02, 0.01), (0.3, 0.15, 0.3, 0.2, 0.05))

# Words of city fields that name no place.
NO_PLACE = frozenset("zdalnie zdalna praca remote home office rozne lokalizacje cala polska teren calego kraju u klienta do uzgodnienia wiele miejscowosci z domu n d brak w m gm woj okolice pl k centrum i lub ul".split())


def _reader(entries: list[tuple[int, str, str | None]]):
    """A function of (names, cities) to the parts of each name and the key of its place."""
    made: list[tuple[Resolver, frozenset[str]]] = []

    @F.pandas_udf("struct<core:string,trades:string,forms:string,person:string,place:string,sorted_core:string,acronym:string>")
    def read(names: pd.Series, cities: pd.Series) -> pd.DataFrame:
        if not made:
            r = Resolver(entries)
            made.append((r, frozenset(w for form in r.forms for w in form.split() if len(w) > 4)))
        resolver, city_words = made[0]
        rows, seen, places = [], {}, {}
        for name, city in zip(names, cities):
            key = (name, city)
            if key not in seen:
                if city not in places:
                    own = fold(city or "")
                    place = ""
                    if own:
                        i = resolver.resolve(city)
                        words = [w for w in own.split() if w not in NO_PLACE and not w.isdigit() and w not in resolver.regions]
                        place = f"#{i}" if i else " ".join(words)
                    places[city] = place, city_words | frozenset(own.split())
                place, own_words = places[city]
                n = read_name(name or "", own_words)
                seen[key] = (n.core, " ".join(n.trades), " ".join(n.forms), n.person, place, n.sorted_core, n.acronym)
            rows.append(seen[key])
        return pd.DataFrame(rows, columns=["core", "trades", "forms", "person", "place", "sorted_core", "acronym"])

    return read


def _core_reader(entries: list[tuple[int, str, str | None]]):
    """A function of names to their cores alone: as typed, with sorted words, initials."""
    made: list[frozenset[str]] = []

    @F.pandas_udf("struct<core:string,sorted_core:string,acronym:string>")
    def read(names: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(frozenset(w for form in Resolver(entries).forms for w in form.split() if len(w) > 4))
        code, unique = pd.factorize(names)
        rows = [(r.core, r.sorted_core, r.acronym) for r in (read_name(n, made[0]) for n in unique)]
        return pd.DataFrame([rows[c] for c in code], columns=["core", "sorted_core", "acronym"])

    return read


def _squares(cores: DataFrame, *sizes: int) -> tuple[int, dict[int, np.ndarray]]:
    """(number of distinct cores, for each n the squared weights of n-grams by bucket), weighted by inverse document frequency.

    Frequencies are counted over all cores in hashed `BUCKETS`, so their table is of one size and goes with the
    functions; vectors are never stored or joined.
    """
    every = cores.select("core").distinct().mapInArrow(core_pairs.counter({n: BUCKETS[n] for n in sizes}), "n int, g int, k bigint")
    rows = every.groupBy("n", "g").agg(F.sum("k").alias("k")).collect()
    total, out = max([r["k"] for r in rows if r["g"] < 0], default=0), {n: np.zeros(BUCKETS[n]) for n in sizes}
    for n, weights in out.items():
        seen = [(r["g"], r["k"]) for r in rows if r["n"] == n and r["g"] >= 0]
        weights[[g for g, _ in seen]] = np.round((np.log(max(1, total) / np.array([k for _, k in seen], float)) + 1.0) ** 2, 4)
    return total, out


def _dealt(cores: DataFrame, n: int) -> DataFrame:
    """The `n` distinct cores over all tasks: they are few bytes, but much is made of each."""
    return cores.select("core").distinct().repartition(_parts(cores, n), "core")


def _parts(cores: DataFrame, n: int) -> int:
    """Tasks that hold all keys of `CORES_A_TASK` cores each at most, whatever the session says."""
    return max(int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // CORES_A_TASK))


def _near_by_deletions(cores: DataFrame, n: int | None = None) -> DataFrame:
    """c1, c2 (c1 < c2), edits of all pairs of distinct `core` values that are equal without `TYPOS` (2) letters of each at most.

    That holds for all cores within two edits, swapped neighbours counted as one; `edits` is 1 for a single swap too. Four
    edits of one letter are two at most only as two swaps, which leave the same letters.
    """
    n = cores.select("core").distinct().count() if n is None else n
    parts = _parts(cores, n)
    near = _dealt(cores, n).filter(F.length("core") <= DELETION_LETTERS + TYPOS).mapInArrow(core_pairs.deletion_indexer(parts), "part int, rows binary")
    near = near.repartition(parts, "part").mapInArrow(core_pairs.deletion_matcher, "c1 string, c2 string, edits int")
    # of the fifths of the shorter of two long cores one is in the other, moved by two places at most: an edit touches two of them at most
    long = cores.select("core").distinct().filter(F.length("core") > DELETION_LETTERS)
    fifth = F.floor(F.col("m") / 5).cast("int")
    start = F.col("k") * fifth + 1
    size = F.when(F.col("k") == 4, F.col("m") - 4 * fifth).otherwise(fifth)
    held = long.withColumn("m", F.length("core")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.col("core").alias("a"), "m", "k", F.substring(F.col("core"), start, size).alias("part"))
    asked = long.withColumn("m", F.explode(F.sequence(F.length("core") - TYPOS, F.length("core")))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("by", F.explode(F.sequence(F.lit(-TYPOS), F.lit(TYPOS))))
    asked = asked.filter(start + F.col("by") >= 1).select(F.col("core").alias("b"), "m", "k", F.substring(F.col("core"), start + F.col("by"), size).alias("part"))
    met = held.join(asked, ["m", "k", "part"]).filter("a <> b").select(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).distinct()
    return near.unionByName(met.mapInArrow(core_pairs.edits_adder, "c1 string, c2 string, edits int")).distinct()


def misspelt_cores(cores: DataFrame, n: int | None = None, squares: np.ndarray | None = None) -> DataFrame:
    """c1, c2 (c1 < c2), edits, cosine of `SHORT_GRAM`-grams of the pairs of `_near_by_deletions`."""
    if squares is None:
        n, by_n = _squares(cores, SHORT_GRAM)
        squares = by_n[SHORT_GRAM]
    near = _near_by_deletions(cores, n).mapInArrow(core_pairs.cosine_adder(SHORT_GRAM, squares), "c1 string, c2 string, edits int, cosine double")
    return near.filter(F.col("cosine") >= SHORT_COSINE)


def linked_cores(cores: DataFrame, n: int | None = None, squares: np.ndarray | None = None) -> DataFrame:
    """c1, c2 (c1 < c2), cosine of the pairs of distinct `core` values at the threshold or above.

    Cores meet by two n-grams that both have (`core_pairs.cosine_keys`), so far fewer pairs meet than by one, and none
    of that cosine is lost.
    """
    if squares is None:
        n, by_n = _squares(cores, GRAM)
        squares = by_n[GRAM]
    index = _dealt(cores, n).mapInArrow(core_pairs.cosine_indexer(GRAM, squares, COSINE, _parts(cores, n)), "part int, rows binary")
    return index.repartition(_parts(cores, n), "part").mapInArrow(core_pairs.cosine_matcher(GRAM, squares, COSINE), "c1 string, c2 string, cosine double").dropDuplicates(["c1", "c2"])


def average_linkage(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, least: float = LINK) -> np.ndarray:
    """The cluster of each node: the smallest node of it. Pairs that aren't given weigh 0."""
    ids = np.unique(nodes)
    label = np.arange(len(ids))
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    x, y = np.minimum(x, y), np.maximum(x, y)
    total, size = weight.astype(float), np.ones(len(ids))
    while len(x):
        mean = total / (size[x] * size[y])
        good = np.flatnonzero(mean >= least)
        if not len(good):
            break
        # each cluster's nearest: the highest mean, ties to the smaller pair
        order = good[np.lexsort((-y[good], -x[good], np.round(mean[good], 12)))]
        best = np.full(len(ids), -1)
        best[x[order]] = order
        second = np.full(len(ids), -1)
        second[y[order]] = order
        rank = np.full(len(total), -1)
        rank[order] = np.arange(len(order))
        nearest = np.where((best >= 0) & ((second < 0) | (rank[best] > rank[second])), best, second)
        merge = good[(nearest[x[good]] == good) & (nearest[y[good]] == good)]
        to = np.arange(len(ids))
        to[y[merge]] = x[merge]
        size[x[merge]] += size[y[merge]]
        label = to[label]
        x, y = to[x], to[y]
        keep = x != y
        x, y, total = np.minimum(x[keep], y[keep]), np.maximum(x[keep], y[keep]), total[keep]
        pair, at = np.unique(x * len(ids) + y, return_inverse=True)
        total = np.bincount(at, weights=total, minlength=len(pair))
        x, y = pair // len(ids), pair % len(ids)
    return ids[label]


def _clusters(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(frames)
    if held:
        f = pd.concat(held, ignore_index=True)
        a, b = f["a"].to_numpy(), f["b"].to_numpy()
        nodes = np.unique(np.concatenate([a, b]))
        yield pd.DataFrame({"node": nodes, "cluster": average_linkage(nodes, a, b, f["weight"].to_numpy())})


def linkage_by_joins(edges: DataFrame, least: float = LINK) -> DataFrame:
    """node, cluster of the edges (a, b, weight), a < b, by the same rounds as joins."""
    label = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node")))
    now = cut(edges.groupBy("a", "b").agg(F.sum("weight").alias("total")))
    while True:
        size = label.groupBy("cluster").agg(F.count("*").alias("n"))
        mean = now.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        good = mean.withColumn("rank", F.struct(F.round(F.col("total") / (F.col("na") * F.col("nb")), 12).alias("m"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).filter(F.col("rank.m") >= least)
        nearest = good.select("rank", F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.max("rank").alias("top"))
        merge = cut(nearest.groupBy("top").agg(F.count("*").alias("k")).filter("k = 2").select((-F.col("top.x")).alias("to"), (-F.col("top.y")).alias("gone")))
        if merge.isEmpty():
            return label
        label = cut(label.join(merge.select(F.col("gone").alias("cluster"), "to"), "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster")))
        moved = now.join(merge.select(F.col("gone").alias("a"), F.col("to").alias("a2")), "a", "left").join(merge.select(F.col("gone").alias("b"), F.col("to").alias("b2")), "b", "left")
        moved = moved.select(F.coalesce("a2", "a").alias("p"), F.coalesce("b2", "b").alias("q"), "total").filter("p <> q")
        now = cut(moved.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("total").alias("total")))


def _levels() -> dict[str, Column]:
    """For each of `FIELDS` whether it is unknown (0), agrees (1) or differs (2) in the two nodes of a pair."""

    def level(f: str) -> Column:
        x, y = F.col(f"{f}1"), F.col(f"{f}2")
        same = x.startswith(y) | y.startswith(x) if f == "person" else x == y  # a first name may be an initial
        return F.when((x == "") | (y == ""), 0).when(same, 1).otherwise(2)

    return {f: level(f) for f in FIELDS}


def estimate(patterns: np.ndarray, counts: np.ndarray, most: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """(log odds of one employer, log ratios by nearness, log ratios of fields that agree or differ) by expectation maximisation.

    `patterns` has a row for each pattern: the nearness, then the levels of `FIELDS`; `counts` says how often it occurs.
    The start counts as `START_PAIRS` pairs, so that small tables keep to it.
    """
    start_near = np.array(START_NEAR)
    start_agree = np.array([[[a, 1 - a] for a in START_AGREE[f]] for f in FIELDS]).transpose(1, 0, 2)  # class, field, level
    near, agree, share = start_near.copy(), start_agree.copy(), START
    held = START_PAIRS * np.array([START, 1 - START])
    known = patterns[:, 1:] > 0
    at = np.maximum(patterns[:, 1:] - 1, 0)

    def odds() -> np.ndarray:
        of_fields = np.log(agree[0] / agree[1])[np.arange(len(FIELDS)), at]
        return np.log(share / (1 - share)) + np.log(near[0] / near[1])[patterns[:, 0]] + (of_fields * known).sum(axis=1)

    for _ in range(most):
        one = 1 / (1 + np.exp(-odds()))
        before = share
        of_class = [counts * one, counts * (1 - one)]
        for c, w in enumerate(of_class):
            near[c] = np.bincount(patterns[:, 0], weights=w, minlength=NEARNESS) + held[c] * start_near[c]
            near[c] /= near[c].sum()
            for f in range(len(FIELDS)):
                seen = np.bincount(at[:, f], weights=w * known[:, f], minlength=2) + held[c] * start_agree[c, f]
                agree[c, f] = seen / seen.sum()
        share = float((of_class[0].sum() + held[0]) / (counts.sum() + held.sum()))
        if abs(share - before) < 1e-9:
            break
    return float(np.log(share / (1 - share))), np.log(near[0] / near[1]), np.log(agree[0] / agree[1])


def _probability(odds: float, near: np.ndarray, agree: np.ndarray) -> Column:
    """The probability of one employer of a row with `near` and the levels of `FIELDS`."""
    total = F.lit(odds) + F.element_at(F.lit([float(x) for x in near]), F.col("near") + 1)
    for f, (yes, no) in zip(FIELDS, agree):
        total += F.when(F.col(f) == 1, float(yes)).when(F.col(f) == 2, float(no)).otherwise(0.0)
    return F.round(1 / (1 + F.exp(-total)), 12)


def _candidates(links: DataFrame, by_node: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b (a < b), near of all nodes with linked cores; the nodes of a common core are dealt to several tasks."""
    n = nodes.count()
    common = by_node.groupBy("core").agg(F.count_distinct("node").alias("n")).filter((F.col("n") > COMMON_NODES) & (F.col("n") > COMMON * n)).select("core", F.ceil(F.sqrt("n")).cast("int").alias("parts"))
    common = cut(common)  # 1 / COMMON times the cores of a node at most
    p, q = (by_node.select(F.col("node").alias(f"n{i}"), F.col("core").alias(f"c{i}"), F.col("initials").alias(f"i{i}")) for i in (1, 2))
    if common.isEmpty():
        pairs = links.join(p, "c1").join(q, "c2")
    else:
        parts = F.broadcast(common.withColumnRenamed("core", "c2"))
        left = links.join(p, "c1").join(parts, "c2", "left").withColumn("part", F.pmod(F.xxhash64("n1"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        right = q.join(parts, "c2", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        pairs = left.join(right, ["c2", "part"]).drop("part")
    # initials of both say nothing, and only equal ones count; of one core two nodes meet in both orders
    ok = (F.col("n1") != F.col("n2")) & ~(F.col("i1") & F.col("i2")) & F.when(F.col("c1") == F.col("c2"), F.col("n1") < F.col("n2")).otherwise(~(F.col("i1") | F.col("i2")))
    near = F.when(F.col("i1") | F.col("i2"), 4).when(F.col("edits").isNull(), 3).otherwise(F.least("edits", F.lit(2)))
    return pairs.filter(ok).groupBy(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).agg(F.min(near).alias("near"))


def employer_clusters(companies: DataFrame, aliases: DataFrame, postings: DataFrame, cities: DataFrame, portals: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """company_id, cluster, normalized_name of every company row whose name has a core.

    NULL or empty names give no spelling, a row without any spelling gets no cluster; NULL cities
    and websites say nothing; aliases and postings of NULL or unknown companies are ignored; repeated
    rows count once. Empty tables give empty results.
    """
    entries = reference_entries(cities)
    read = _reader(entries)
    hosts = portals.select(website_host(F.col("host")).alias("_host")).dropna().distinct().withColumn("_portal", F.lit(True))
    c = companies.select(F.col("id").cast("bigint").alias("id"), "canonical_name", "normalized_name", "city", website_host(F.col("website_url")).alias("_host")).filter("id is not null")
    c = c.join(hosts, "_host", "left").withColumn("host", F.when(F.col("_portal").isNull(), F.col("_host"))).drop("_host", "_portal").dropDuplicates(["id"])
    own = cut(c.select("id", "normalized_name", F.coalesce("host", F.lit("")).alias("host"), read(F.coalesce("canonical_name", F.lit("")), "city").alias("p")).select("id", "normalized_name", "host", "p.*"))
    key = ["core", "trades", "forms", "person", "place", "host"]
    nodes = own.groupBy(*key).agg(F.min("id").alias("node"))
    member = cut(own.join(nodes, key).select("id", "node", "normalized_name", "core", "sorted_core", "acronym"))
    other = aliases.select(F.col("company_id").cast("bigint").alias("id"), F.col("alias").alias("name")).unionByName(postings.select(F.col("company_id").cast("bigint").alias("id"), F.col("company_name_raw").alias("name")))
    other = other.unionByName(c.select("id", F.col("host").alias("name"))).filter("id is not null and name <> ''").distinct()
    spelt = other.select("id", _core_reader(entries)("name").alias("p")).select("id", "p.*").join(member.select("id", "node"), "id").drop("id")
    spelt = spelt.unionByName(member.select("node", "core", "sorted_core", "acronym")).distinct()
    by_node = spelt.select("node", F.explode(F.array(*[F.struct(F.col(x).alias("core"), F.lit(x == "acronym").alias("initials")) for x in ("core", "sorted_core", "acronym")])).alias("s")).select("node", "s.*")
    by_node = cut(by_node.filter(F.length("core") >= CORE_LETTERS).distinct())
    cores = cut(by_node.filter("not initials").select("core").distinct())
    n, squares = _squares(cores, GRAM, SHORT_GRAM)
    links = linked_cores(cores, n, squares[GRAM]).select("c1", "c2", F.lit(None).cast("int").alias("edits")).unionByName(misspelt_cores(cores, n, squares[SHORT_GRAM]).select("c1", "c2", "edits"))
    links = links.groupBy("c1", "c2").agg(F.min("edits").alias("edits"))
    links = cut(links.unionByName(by_node.select(F.col("core").alias("c1"), F.col("core").alias("c2"), F.lit(0).alias("edits")).distinct()))
    x, y = (nodes.select(*[F.col(k).alias(f"{k}{i}") for k in FIELDS], F.col("node").alias(n)) for i, n in ((1, "a"), (2, "b")))
    pairs = cut(_candidates(links, by_node, nodes).join(x, "a").join(y, "b").select("a", "b", "near", *[c.alias(f) for f, c in _levels().items()]))
    # the patterns are at most NEARNESS times 3 to the number of FIELDS
    seen = [tuple(r) for r in pairs.groupBy("near", *FIELDS).count().collect()]
    model = estimate(np.array([r[:-1] for r in sorted(seen)], int).reshape(-1, 1 + len(FIELDS)), np.array([r[-1] for r in sorted(seen)], float))
    edges = cut(pairs.select("a", "b", _probability(*model).alias("weight")).filter(F.col("weight") >= LEAST))
    parts = cut(components(edges.filter(F.col("weight") >= LINK)))
    # a link between two parts is never part of a mean that merges: parts are joined by no pair of LINK
    inside = edges.join(parts.select(F.col("node").alias("a"), F.col("group_id").alias("ga")), "a").join(parts.select(F.col("node").alias("b"), F.col("group_id").alias("gb")), "b").filter("ga = gb").select("ga", "a", "b", "weight")
    big = [r.ga for r in inside.groupBy("ga").count().filter(F.col("count") > part_edges).select("ga").limit(1).collect()]
    if big:
        sizes = inside.groupBy("ga").count()
        inside = inside.join(sizes, "ga")
        small, large = inside.filter(F.col("count") <= part_edges), inside.filter(F.col("count") > part_edges)
        found = small.repartition("ga").select("a", "b", "weight").mapInPandas(_clusters, "node bigint, cluster bigint").unionByName(linkage_by_joins(large.select("a", "b", "weight")))
    else:
        found = inside.repartition("ga").select("a", "b", "weight").mapInPandas(_clusters, "node bigint, cluster bigint")
    return member.join(found, "node", "left").select(F.col("id").alias("company_id"), F.coalesce("cluster", "node").alias("cluster"), "normalized_name")


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """company_id_a, company_id_b (a < b) of companies of one cluster whose normalized names differ.

    Rows are grouped by cluster and name first, so rows of equal name never meet. A NULL name differs
    from none.
    """
    c = clusters.filter("normalized_name is not null")
    names = c.select("cluster", "normalized_name").distinct()
    n1, n2 = (names.select("cluster", F.col("normalized_name").alias(f"n{i}")) for i in (1, 2))
    differing = n1.join(n2, "cluster").filter("n1 < n2")
    a = c.select("cluster", F.col("normalized_name").alias("n1"), F.col("company_id").alias("a"))
    b = c.select("cluster", F.col("normalized_name").alias("n2"), F.col("company_id").alias("b"))
    out = differing.join(a, ["cluster", "n1"]).join(b, ["cluster", "n2"])
    return out.select(F.least("a", "b").alias("company_id_a"), F.greatest("a", "b").alias("company_id_b"))
