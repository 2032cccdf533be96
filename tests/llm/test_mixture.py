"""Cube sampling: exact balance, inclusion probabilities, quotas, and mixtures of odd tables."""

import numpy as np
import pytest

from vacantia.llm import mixture as mx


def test_flight_keeps_totals_and_leaves_two():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 800):
        for x in (rng.integers(1, 500, n), np.full(n, 7)):
            p = np.full(n, 0.37)
            out = mx.fly(p, x, np.random.default_rng(n))
            left = ((out > 0) & (out < 1)).sum()
            assert left <= 2 and abs(out.sum() - p.sum()) < 1e-6 * max(1, n) and abs((out * x).sum() - (p * x).sum()) < 1e-3 * max(1, n)
            landed = mx.land(out, x)
            assert set(landed.tolist()) <= {0.0, 1.0}


def test_flight_keeps_inclusion_probabilities():
    x = np.array([1, 5, 9, 100, 40, 40, 3, 8])
    p = np.array([0.2, 0.5, 0.7, 0.3, 0.6, 0.1, 0.9, 0.5])
    mean = np.mean([mx.fly(p, x, np.random.default_rng(i)) for i in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_quotas_fill_what_capped_sources_leave():
    q = mx.quotas(1000, {"a": 600, "b": 300, "c": 50}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 2), "d": (0.1, 9)})
    assert q["c"] == 100 and abs(q["a"] - 900 * 5 / 8) < 1e-9 and abs(sum(q.values()) - 1000) < 1e-9
    assert mx.quotas(1000, {"a": 10}, {"a": (1.0, 3)}) == {"a": 30} and mx.quotas(0, {}, {}) == {}


def frame(spark, n):
    rng = np.random.default_rng(2)
    words = ["Szukamy", "kucharza", "od", "zaraz", "welder", "wanted", "now"]
    rows = [(i, " ".join(rng.choice(words, int(k))), s, "x") for i, (s, k) in enumerate(zip(rng.choice(["big", "mid", "small", "odd"], n, p=[0.6, 0.25, 0.1, 0.05]), rng.integers(1, 60, n)))]
    return rows + [(n, None, "big", "x"), (n + 1, "", "mid", "x"), (n + 2, "text", None, "x"), (5, "repeated row", "mid", "x"), (5, "repeated row", "mid", "x")]


SCHEMA, GOALS = "doc_id bigint, text string, source string, copies string", [("big", 0.4, 1), ("mid", 0.35, 3), ("small", 0.25, 2), ("absent", 0.1, 2)]


@pytest.mark.parametrize("block", [50_000, 60])
def test_mixture_reaches_targets_and_is_repeatable(spark, monkeypatch, block):
    monkeypatch.setattr(mx, "BLOCK", block)
    docs = spark.createDataFrame(frame(spark, 3000), SCHEMA).repartition(4, "doc_id").sortWithinPartitions("doc_id", "text")
    goals = spark.createDataFrame(GOALS + [("big", 0.4, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn, plan = mx.mixture(docs, goals)
    rows = drawn.collect()
    shares = {r.source: r for r in mx.mixture_shares(drawn, plan).collect()}
    assert set(shares) == {"big", "mid", "small", "absent"} and shares["absent"].mixture_tokens == 0
    most = {s: m for s, _, m in GOALS}
    assert all(1 <= r.copies <= most[r.source] and r.n_tokens > 0 for r in rows)
    for s in ("big", "mid", "small"):
        assert abs(shares[s].mixture_tokens - shares[s].quota) <= 120, s
        assert shares[s].most_copies <= most[s]
    assert shares["small"].mixture_tokens == 2 * shares["small"].n_tokens  # capped
    for parts in (2, 5):
        assert sorted(map(tuple, mx.mixture(docs.repartition(parts), goals)[0].collect())) == sorted(map(tuple, rows))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    goals = spark.createDataFrame(GOALS, "source string, target_share double, max_repeats int")
    drawn, plan = mx.mixture(docs, goals)
    assert drawn.count() == 0 and {r.actual_share for r in mx.mixture_shares(drawn, plan).collect()} == {0.0}
    some = spark.createDataFrame(frame(spark, 20), SCHEMA)
    assert mx.mixture(some, goals.limit(0))[0].count() == 0
