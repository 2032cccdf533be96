"""Consolidating pairwise matches into groups by union-find within partitions.

The records and the things that tie them form a bipartite graph. Three steps find its components:

1. every input partition runs union-find over its own rows, a bounded chunk at a time, and keeps a
   spanning forest: one edge from each record to the smallest record of its local tree, and one
   representative per key and chunk. No shuffle comes before this, so a key on a third of all rows
   leaves its partition once a chunk;
2. the representatives of one key are sorted and each is tied to the one before it, which ties all of
   them however many chunks or tasks they come from;
3. the edges are dealt over partitions of about `per_task` edges. Each keeps a spanning forest only.
   The forests are merged by contraction: a record that is the root of no tree is settled under its root and
   leaves the graph, and only what ties the roots goes up to the next level, through fewer partitions. When what is left
   fits one partition, that is merged and the settled records get their groups level by level, downwards.

Only edges of forests are shuffled. Roots are drawn by a hash of the record, so a level settles a fixed
share of the records even of a path. A root with very many records is salted where records meet its
group. Nothing goes to the driver but one count a level. Levels are cut with `checkpoint`, so a lost
executor costs one level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.session import cut

#: Most edges that one task of a merging level holds: 16 bytes each, and about ten times that at work.
PER_TASK = 1_000_000
#: Rows of the input that are gathered for one local forest.
CHUNK = 250_000
#: Records under one root from which it is salted, at least; never more than `HOT_ROOTS` roots are.
HOT, HOT_ROOTS, SALT = 1_000_000, 100_000, 64
EDGE = "a bigint, b bigint"


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of the edges (a, b): each node but the roots, and the smallest node of its tree.

    Hooking and pointer jumping over whole arrays: every round hooks the larger root of each edge
    under the smaller and halves all paths, until no edge joins two trees.
    """
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            break
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _chunks(frames: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _tie(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, a) to forest edges (key NULL, a, b) and representatives (key, a)."""
    for f in _chunks(frames, CHUNK):
        code, keys = pd.factorize(f["key"], sort=False)
        record = f["a"].to_numpy(np.int64)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, code, record)
        child, root = local_forest(record, least[code])
        if len(child):
            yield pd.DataFrame({"key": pd.Series([None] * len(child), dtype=object), "a": child, "b": root})
        yield pd.DataFrame({"key": keys, "a": least, "b": least})


def _merge(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(frames)
    if held:
        f = pd.concat(held, ignore_index=True)
        child, root = local_forest(f["a"].to_numpy(np.int64), f["b"].to_numpy(np.int64))
        yield pd.DataFrame({"a": child, "b": root})


def components(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = PER_TASK) -> DataFrame:
    """node, group_id for every node of an edge between two different nodes; group_id is the group's smallest node.

    Nodes are bigints. Edges with a NULL end or from a node to itself tie nothing; repeated and
    reversed edges count once. No edges, no rows.
    """
    pairs = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a <> b")
    return _merge_forests(pairs.mapInPandas(_merge_chunks, EDGE), per_task)


def _merge_chunks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in _chunks(frames, CHUNK):
        yield from _merge([f])


def _rank(nodes: np.ndarray) -> np.ndarray:
    """A number for each node that says nothing of its size: a 64-bit finaliser, one to one."""
    x = nodes.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _forests(rows: int):
    """Edges (a, b) to forest edges (a, b, rank of b), where b is the node of the least rank in its tree; `rows` edges at a time."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _chunks(frames, rows):
            ends = np.unique(f[["a", "b"]].to_numpy(np.int64))
            ranks = _rank(ends)
            order = np.argsort(ranks)
            place = np.empty(len(ends), np.int64)
            place[order] = np.arange(len(ends))
            child, root = local_forest(*(place[np.searchsorted(ends, f[c].to_numpy(np.int64))] for c in "ab"))
            yield pd.DataFrame({"a": ends[order[child]], "b": ends[order[root]], "rank": ranks[order[root]]})

    return run


def _grouped(settled: DataFrame, groups: DataFrame, hot: int) -> DataFrame:
    """node, group_id of (node, root) and groups (root, group_id); a root with more than `hot` nodes is salted."""
    heavy = settled.groupBy("root").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select("root", F.lit(SALT).alias("_salts"))
    # at most 1 / hot of the nodes are such roots: HOT_ROOTS rows
    dealt = settled.join(F.broadcast(heavy), "root", "left").withColumn("_salt", F.pmod(F.xxhash64("node"), F.coalesce("_salts", F.lit(1))))
    spread = groups.join(F.broadcast(heavy), "root", "left").select("root", "group_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1)).alias("_salt"))
    return dealt.join(spread, ["root", "_salt"]).select("node", "group_id")


def _merge_forests(edges: DataFrame, per_task: int) -> DataFrame:
    edges = cut(edges)
    n = edges.count()
    if n <= per_task:
        return _members(edges.coalesce(1).mapInPandas(_merge, EDGE))
    hot = max(HOT, n // HOT_ROOTS)
    levels: list[DataFrame] = []
    while n > per_task:
        forest = edges.repartition(-(-n // per_task), "a").mapInPandas(_forests(per_task), "a bigint, b bigint, rank bigint")
        forest = cut(forest)
        # a node is in one tree a partition: its roots are tied to the first of them
        first = F.min(F.struct("rank", "b")).over(Window.partitionBy("a"))
        roots = forest.select(F.col("b").alias("a"), F.lit(True).alias("_root")).distinct()
        tied = cut(forest.withColumn("to", first["b"]).select("a", "b", "to").join(roots, "a", "left"))
        levels.append(tied.filter("_root is null").select(F.col("a").alias("node"), F.col("to").alias("root")).distinct())
        up = tied.filter("b <> to").select(F.col("b").alias("x"), F.col("to").alias("y")).unionByName(tied.filter("_root").select(F.col("a").alias("x"), F.col("to").alias("y")))
        edges = cut(up.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        n = edges.count()
    groups = _members(edges.coalesce(1).mapInPandas(_merge, EDGE)).select(F.col("node").alias("root"), "group_id")
    for settled in reversed(levels):
        whole = settled.select("root").distinct().join(groups, "root", "left").select("root", F.coalesce("group_id", "root").alias("group_id"))
        below = _grouped(settled, whole, hot)
        # roots of this level that tie nothing above are groups of their own
        rest = groups.join(whole.select("root"), "root", "left_anti")
        groups = cut(below.select(F.col("node").alias("root"), "group_id").unionByName(whole).unionByName(rest))
    groups = groups.withColumnsRenamed({"root": "node", "group_id": "root"})
    return _grouped(groups, groups.groupBy("root").agg(F.min("node").alias("group_id")), hot)


def _members(forest: DataFrame) -> DataFrame:
    return forest.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("group_id")), F.struct(F.col("b").alias("node"), F.col("b").alias("group_id")))).alias("_m")).select("_m.*").distinct()


def tied_groups(rows: DataFrame, record: Column, key: Column, per_task: int = PER_TASK) -> DataFrame:
    """node, group_id of every record that a shared key ties, over any number of steps, to another record.

    Rows with a NULL record or key tie nothing; repeated rows count once; other columns of `rows`
    are ignored, whatever they are called. group_id is the group's smallest record.
    """
    ties = rows.select(key.cast("string").alias("key"), record.cast("bigint").alias("a")).dropna()
    first = cut(ties.mapInPandas(_tie, "key string, a bigint, b bigint"))
    inside = first.filter("key is null").select("a", "b")
    before = F.lag("a").over(Window.partitionBy("key").orderBy("a"))
    between = first.filter("key is not null").select("a", before.alias("b")).filter("a <> b")
    return _merge_forests(inside.unionByName(between), per_task)
