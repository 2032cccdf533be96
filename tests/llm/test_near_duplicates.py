"""Near-duplicate pairs against all pairs of a small log, and the parts of the sketch."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from vacantia.llm import near_duplicates as nd

SCHEMA = "id bigint, source string, source_id string, title string, description string, t bigint, words string"
VOCABULARY = [f"słowo{i}" for i in range(400)] + ["praca", "The", "job"]


def log(seed, texts, copies):
    rng = random.Random(seed)
    rows = []
    for k in range(texts):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, copies)):
            w = list(words)
            for _ in range(rng.randrange(0, 14)):
                at = rng.randrange(len(w)) if w else 0
                action = rng.random()
                if action < 0.4:
                    w[at : at + 1] = []
                elif action < 0.8:
                    w.insert(at, rng.choice(VOCABULARY))
                else:
                    w = w[at:] + w[:at]
            for _ in range(rng.randrange(1, 4)):
                key = rng.choice([("a", f"{k}"), ("b", f"{k}-{rng.randrange(3)}"), (None, "1"), ("a", None)])
                rows.append((*key, rng.choice(["Kucharz, zmiana", "kucharz zmiana", None]), rng.choice([" ", "\n* "]).join(w)))
    rows += [("a", "x", "T", None), ("a", "y", "T", "  \n"), ("c", "1", "T", "dwa słowa"), ("c", "2", "T", "dwa słowa"), ("c", "3", None, "jedno"), ("c", "4", None, "jedno"), ("d", "1", "L", "bardzo długi tekst " * 4000 + "x"), ("d", "2", "L", "bardzo długi tekst " * 4000 + "x")]
    return [(i + 1, *r, i, "clash") for i, r in enumerate(rows)]


def brute(rows):
    sets = {}
    for i, _, _, title, body, *_ in rows:
        if body and body.strip():
            w = re.findall(r"[^\W_]+", f"{title or ''} {body}".lower())
            sets[i] = set(zip(w, w[1:], w[2:]))
    key = {r[0]: (r[1], r[2]) for r in rows}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and not (key[a] == key[b] and None not in key[a]):
                both = len(sets[a] & sets[b])
                if 10 * both >= 6 * (len(sets[a]) + len(sets[b]) - both):
                    out.add((a, b))
    return out


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = nd.near_duplicate_pairs(df, "id", ["title", "description"], "description", ["source", "source_id"])
    return [tuple(r) for r in out.collect()]


def test_all_pairs_of_a_small_log(spark):
    rows = log(1, 90, 4)
    got, want = pairs(spark, rows), brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_one_text_under_most_keys(spark):
    rows = [(i, "s", f"{i // 3}", "Kucharz", "jeden dwa trzy cztery pięć", 0, "") for i in range(60)]
    got = pairs(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("hot", [5, 5_000])
def test_hot_texts_are_dealt_by_key(spark, monkeypatch, hot):
    monkeypatch.setattr(nd, "HOT", hot)
    rows = [(i, "s", f"{i // 2}", "Kucharz", "jeden dwa trzy cztery pięć sześć siedem osiem", 0, "") for i in range(70)]
    rows += [(100 + i, "s", f"{i // 2}" if i % 3 else None, "Kucharz", "jeden dwa trzy cztery pięć sześć siedem dziewięć", 0, "") for i in range(50)]
    got = pairs(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 5000


def test_pivot_table_discards_and_loses_nothing(spark):
    """Families around few texts that share a fifth of them: most candidates are false, references stand in the families."""
    rng = random.Random(9)
    common = [rng.choice(VOCABULARY) for _ in range(60)]
    texts = []
    for _ in range(12):
        own = [rng.choice(VOCABULARY) for _ in range(80)]
        for _ in range(12):
            w = common + own
            w[rng.randrange(len(w))] = "inne"
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "h1 bigint, h2 bigint, words string").distinct()
    counts = {}
    with nd.written_sketches(df) as s:
        got = {(r.t1, r.t2) for r in nd.similar_texts(s, counts=counts).collect()}
        name = s.inputFiles()[0]
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 10 * len(sets[i] & sets[j]) >= 6 * len(sets[i] | sets[j])}
    assert got == want and counts["candidates"] > 2 * len(want)
    assert counts["pivots"] > 0.5 * (counts["candidates"] - len(want))
    assert not Path(name.removeprefix("file:")).exists()


def test_pivot_rows_are_hamming_distances(spark):
    rng = np.random.default_rng(4)
    fps = rng.integers(-(2**63), 2**63 - 1, (5, nd._FP))
    df = spark.createDataFrame([tuple(map(int, r)) for r in fps], ", ".join(f"f{i} bigint" for i in range(nd._FP)))
    got = [list(r[0]) for r in df.select(nd._row_of_pivots(fps[:3])).collect()]
    bits = lambda x, y: sum(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(x, y))
    assert sorted(got) == sorted([bits(f, p) - 128 for p in fps[:3]] for f in fps)


def test_empty_table(spark):
    assert pairs(spark, [(1, "a", "b", None, None, 0, "")]) == []


def test_shingles_and_sketches_estimate_similarity():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 200))) for _ in range(50)]
    texts += [t + " koniec zdania teraz" for t in texts]
    shingles, counts = nd.shingle_sets(texts, nd._Words())
    want = [len(set(zip(w, w[1:], w[2:]))) for w in (t.split() for t in texts)]
    assert counts.tolist() == want and len(shingles) == sum(want)
    have = counts > 0
    minima = nd.sketches(shingles, counts[have])
    fp, bands = nd.fingerprints(minima), nd.band_hashes(minima)
    assert fp.shape[1] * 64 == nd.BANDS * nd.ROWS and bands.shape[1] == nd.BANDS
    at = np.cumsum(have) - 1
    for i in range(50):
        if want[i] > 40:
            x, y = minima[at[i]], minima[at[i + 50]]
            assert abs((x == y).mean() - want[i] / (want[i] + 3)) < 0.12
            bits = sum(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(fp[at[i]], fp[at[i + 50]]))
            assert bits < nd.FAR / 2
            far = sum(bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(fp[at[i]], fp[at[(i + 1) % 50 if want[(i + 1) % 50] > 40 else i]]))
            assert far == 0 or far > nd.FAR * 0.9
