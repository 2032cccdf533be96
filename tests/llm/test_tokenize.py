"""Encoding against the merge rule done one pair at a time, and against a public implementation."""

import random

import numpy as np
import pytest

from vacantia.llm import tokenize as tk

TEXTS = [
    "Szukamy kucharza, od zaraz!", "  two  blanks\n\n\nand lines ", "Łódź – żółć 🚀🚀 дім", "", None, " ", "\x00\x01", "<|endoftext|>", "we'll they've I'd", "aaaaaaaaaaaa" * 40, "ab" * 900, "x" * 20_000, " " * 3_000, "\n" * 777,
    "123456789012345678901234567890" * 9, "!?" * 300, "é́" * 100,
]


@pytest.fixture(scope="module")
def encoder():
    ranks = tk.read_ranks(tk.DEFAULT_VOCABULARY)
    return tk.Encoder(ranks, tk.PairTable(ranks))


def lists(encoded):
    ids, lengths = encoded
    return [a.tolist() for a in np.split(ids, np.cumsum(lengths)[:-1])]


def one_by_one(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        at = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if at is None:
            return [ranks[p] for p in parts]
        parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]


def test_rows_and_heap_merge_like_one_pair_at_a_time(encoder):
    rng = random.Random(1)
    pieces = ["".join(rng.choice("aabcełśtion пр") for _ in range(rng.randrange(1, 60))).encode() for _ in range(600)]
    want = [one_by_one(encoder.ranks, p) for p in pieces]
    rows = [encoder.byte_ids[np.frombuffer(p, np.uint8)] for p in pieces]
    wide = max(map(len, rows))
    matrix = np.array([np.pad(r, (0, wide - len(r)), constant_values=-1) for r in rows])
    assert [x.tolist() for x in tk.merge_rows(matrix, np.array(list(map(len, rows))), encoder.pairs)] == want
    assert [tk.merge_long(r, encoder.pairs).tolist() for r in rows] == want


def test_agrees_with_a_public_implementation(encoder, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    public = tiktoken.Encoding("own", pat_str=tk.PIECES, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("aab łаż,.!🚀 1\n'") for _ in range(rng.randrange(300))) for _ in range(500)]
    want = [public.encode_ordinary(t or "") for t in texts]
    assert lists(encoder.encode(texts)) == want
    monkeypatch.setattr(tk, "KEPT_PIECES", 50)  # the store of pieces starts anew each time
    assert [lists(encoder.encode([t]))[0] for t in texts] == want


def test_pair_table_finds_every_pair_and_no_other(encoder):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, 20000), rng.integers(0, 50256, 20000)
    by_id = {v: k for k, v in encoder.ranks.items()}
    want = [encoder.ranks.get(by_id[x] + by_id[y], int(tk.NO_RANK)) for x, y in zip(a.tolist(), b.tolist())]
    assert encoder.pairs.ranks(a, b).tolist() == want


def test_documents(spark, encoder):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted((r.doc_id, list(r.ids)) for r in tk.encode_documents(df).collect())
    assert got == sorted((i, ids) for i, ids in enumerate(lists(encoder.encode(TEXTS)) + lists(encoder.encode(TEXTS[:1]))) for i in [i if i < len(TEXTS) else 0])
    counts = {r.doc_id: (r.n_tokens, r.ids) for r in tk.encode_documents(df, counts_only=True, keep=("ids",)).collect()}
    assert counts[3] == (0, "x") and counts[4] == (0, "x") and counts[0] == (len(lists(encoder.encode(TEXTS[:1]))[0]), "x")
    assert tk.encode_documents(df.limit(0)).count() == 0
