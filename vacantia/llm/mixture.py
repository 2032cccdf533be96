"""Problem 9: mixing sources to target weights by cube-method balanced sampling.

Each source gets a quota of the mixture's tokens: its target share, or `max_repeats` times its own
tokens where that is less; what capped sources leave goes to the others in proportion to their
targets. A quota of r times a source's tokens means floor(r) copies of every document and one more of
a sample in which every document has the inclusion probability r - floor(r).

The sample is drawn by the cube method. A point of inclusion probabilities moves along directions in
the null-space of the constraints (number of documents, number of tokens), a random step each time
that fixes at least one document and keeps both totals in expectation and in fact, until two
documents at most are left. Blocks of a source (bounded, hashed by document) fly in parallel; the few
undecided documents of all blocks fly together next; the two left at last are landed by rounding.
Draws are seeded by block, and blocks and the order within them come from the documents alone, so the
draw is the same however the input is split into files and tasks. Rows that repeat a document are told apart by a number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.tokenize import DEFAULT_VOCABULARY, encode_documents
from vacantia.session import cut

#: Documents of one source that one block holds, about.
BLOCK = 50_000
#: Most sources that a target table may list; their totals are planned on the driver.
MAX_SOURCES = 100_000
SEED = 20240917


def fly(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves `p` to 0 or 1 in all places but two at most, keeping sum(p) and sum(p * x)."""
    p = p.astype(float).copy()
    eps = 1e-9
    open_ = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    held: list[int] = []
    draw = iter(rng.random(2 * len(open_) + 2).tolist())
    values, sizes = p.tolist(), x.astype(float).tolist()
    nxt = 0
    while True:
        while len(held) < 3 and nxt < len(open_):
            held.append(open_[nxt])
            nxt += 1
        t = [sizes[i] for i in held]
        if len(held) == 3 and not (t[0] == t[1] == t[2]):
            u = [t[2] - t[1], t[0] - t[2], t[1] - t[0]]
        elif len(held) >= 2 and t[0] == t[1]:
            u = [1.0, -1.0] + [0.0] * (len(held) - 2)
        else:
            break
        up = min(((1 - values[i]) / d if d > 0 else values[i] / -d) for i, d in zip(held, u) if d)
        down = min((values[i] / d if d > 0 else (1 - values[i]) / -d) for i, d in zip(held, u) if d)
        step = up if next(draw) * (up + down) < down else -down
        for i, d in zip(held, u):
            v = values[i] + step * d
            values[i] = 0.0 if v < eps else 1.0 if v > 1 - eps else v
        held = [i for i in held if 0.0 < values[i] < 1.0]
    return np.array(values)


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounds what is left so that the token total ends nearest to its expectation; ties to fewer documents."""
    out = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[left] * x[left]).sum())
    choices = [np.array([(m >> k) & 1 for k in range(len(left))], float) for m in range(1 << len(left))]
    if len(left):
        out[left] = min(choices, key=lambda c: (abs(float((c * x[left]).sum()) - want), c.sum()))
    return out


def quotas(total: float, tokens: dict[str, float], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens of the mixture that each source contributes."""
    share = {s: w for s, (w, _) in targets.items() if w > 0 and tokens.get(s, 0) > 0}
    cap = {s: tokens[s] * targets[s][1] for s in share}
    fixed: dict[str, float] = {}
    while True:
        free = [s for s in share if s not in fixed]
        rest = total - sum(fixed.values())
        weight = sum(share[s] for s in free)
        over = [s for s in free if rest * share[s] / weight >= cap[s]]
        if not over:
            return fixed | {s: rest * share[s] / weight for s in free}
        fixed |= {s: cap[s] for s in over}


def mixture_plan(sizes: DataFrame, targets: DataFrame) -> pd.DataFrame:
    """One row per target source: shares, quota, whole copies, probability of one more, blocks."""
    listed = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = {r[0]: (r[1], r[2]) for r in listed}
    per = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("docs")).join(targets.select("source").distinct(), "source", "left_semi").collect()}
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    quota = quotas(float(total), {s: float(r["tokens"]) for s, r in per.items()}, goal)
    weight = sum(w for w, _ in goal.values()) or 1.0
    rows = []
    for s, (w, most) in sorted(goal.items()):
        own = float(per[s]["tokens"]) if s in per else 0.0
        times = quota.get(s, 0.0) / own if own else 0.0
        whole = min(int(times + 1e-12), most)
        docs = int(per[s]["docs"]) if s in per else 0
        rows.append((s, w / weight, most, docs, int(own), quota.get(s, 0.0), whole, 0.0 if whole == most else max(0.0, times - whole), max(1, -(-docs // BLOCK))))
    return pd.DataFrame(rows, columns=["source", "target_share", "max_repeats", "n_documents", "n_tokens", "quota", "whole", "more", "blocks"])


_FLOWN = "source string, block bigint, doc_id bigint, row bigint, n_tokens bigint, p double"


def _flight(last: bool):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "n_tokens", "row"], ignore_index=True)
        rng = np.random.default_rng([SEED, *key[0].encode(), int(key[1]) + 1])
        x = f["n_tokens"].to_numpy()
        p = fly(f["p"].to_numpy(), x, rng)
        return f.assign(p=land(p, x) if last else p)

    return run


def mixture(documents: DataFrame, targets: DataFrame, sizes: DataFrame | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, pd.DataFrame]:
    """(doc_id, source, n_tokens, copies of every document in the mixture; the plan it was drawn by).

    Sources that are NULL or not listed are left out, but count towards the size of the mixture;
    documents without tokens (NULL and empty texts) contribute nothing and are left out. Repeated
    rows are documents of their own. `sizes` may give doc_id, source and n_tokens ready made.
    """
    if sizes is None:
        sizes = encode_documents(documents, vocabulary=vocabulary, counts_only=True, keep=("source",))
    # rows that are equal in all of this are numbered: which of them is drawn makes no difference
    alike = sizes.groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("_rows"))
    sizes = cut(alike.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).alias("row")))
    plan = mixture_plan(sizes, targets)
    dim = sizes.sparkSession.createDataFrame(plan[["source", "whole", "more", "blocks"]], "source string, whole int, more double, blocks bigint")
    drawn = sizes.filter("n_tokens > 0").join(dim, "source")
    drawn = drawn.withColumn("block", F.pmod(F.xxhash64("doc_id", "n_tokens", "row"), "blocks"))
    flown = cut(drawn.filter("more > 0").select("source", "block", "doc_id", "row", "n_tokens", F.col("more").alias("p")).groupBy("source", "block").applyInPandas(_flight(False), _FLOWN))
    undecided = flown.filter("p > 0 and p < 1").withColumn("block", F.lit(-1).cast("bigint"))
    landed = undecided.groupBy("source", "block").applyInPandas(_flight(True), _FLOWN)
    extra = flown.filter("p = 1").unionByName(landed.filter("p = 1")).select("doc_id", "source", "n_tokens", "row", F.lit(1).alias("extra"))
    out = drawn.join(extra, ["doc_id", "source", "n_tokens", "row"], "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies"), plan


def mixture_shares(drawn: DataFrame, plan: pd.DataFrame) -> DataFrame:
    """Per target source what was asked for and what came out."""
    dim = drawn.sparkSession.createDataFrame(plan[["source", "target_share", "max_repeats", "n_documents", "n_tokens", "quota"]], "source string, target_share double, max_repeats int, n_documents bigint, n_tokens bigint, quota double")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixture_tokens"), F.sum("copies").cast("bigint").alias("mixture_documents"), F.max("copies").alias("most_copies"))
    got = got.withColumn("_total", F.sum("mixture_tokens").over(Window.partitionBy()))  # one row per source
    out = dim.join(got, "source", "left")
    return out.select(
        "source", "target_share", "max_repeats", "n_documents", "n_tokens", "quota", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mixture_tokens", "mixture_documents", "most_copies")],
        F.coalesce(F.col("mixture_tokens") / F.col("_total"), F.lit(0.0)).alias("actual_share"),
    )
