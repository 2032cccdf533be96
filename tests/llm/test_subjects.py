"""Topic models: inference and sums against plain arithmetic, held-out samples, odd tables."""

import zlib

import numpy as np
import pandas as pd
import pytest

from vacantia.llm import subjects as sj

DATA = "/root/testdata/sf0.001"


def test_sentences():
    got = sj.sentences("Kierowca C+E.​ Praca w trasie!\n• Karta kierowcy<br>ok")
    want = [["kierowca"], ["praca", "trasie"], ["karta", "kierowcy"]]
    assert got == [[zlib.crc32(w[: sj.STEM].encode()) % sj.BUCKETS for w in s] for s in want]
    assert sj.sentences(None) == sj.sentences("") == sj.sentences(" \n 12 ab") == []


def padded(docs):
    f = pd.DataFrame({"kinds": [np.unique(d) for d in docs], "counts": [np.unique(d, return_counts=True)[1] for d in docs]})
    return list(sj._padded(f))


def test_inference_is_the_fixed_point_of_each_document():
    rng = np.random.default_rng(1)
    weights = rng.dirichlet(np.ones(50), 4).T.astype(np.float32)
    docs = [rng.integers(0, 50, n) for n in (3, 40, 7, 0, 41, 200)]
    seen = set()
    for rows, kinds, counts in padded(docs):
        theta, share, likelihood = sj.infer(kinds, counts, weights, inner=6)
        total = 0.0
        for d, t_d, k, n, sh in zip(rows, theta, kinds, counts, share):
            seen.add(int(d))
            ws, t = docs[d], np.full(4, 0.25)
            for _ in range(6):
                q = weights[ws] * t
                q /= q.sum(axis=1, keepdims=True)
                new = q.sum(axis=0) + sj.ALPHA
                new /= new.sum()
                moved, t = np.abs(new - t).max(), new
            assert np.allclose(t_d, t, atol=2e-2 if moved < sj.STANDING else 1e-3)
            mine = np.array([sh[i] * weights[k[i]] * t_d for i in range(len(k)) if n[i]]).sum(axis=0)
            assert abs(mine.sum() - len(ws)) < 1e-3 * len(ws)
            total += np.log(weights[ws] @ t_d).sum()
        assert abs(total - likelihood) < 1e-3 * abs(total)
    assert seen == {0, 1, 2, 4, 5}


def test_inference_runs_until_proportions_stand():
    rng = np.random.default_rng(3)
    weights = rng.dirichlet(np.full(200, 0.3), 6).T.astype(np.float32) + np.float32(1e-6)
    docs = [np.concatenate([rng.choice(200, 60, p=weights[:, k] / weights[:, k].sum()) for k in ks]) for ks in ((0, 1), (2, 3), (4, 5), (0, 3))]
    for _, kinds, counts in padded(docs):
        done = sj.infer(kinds, counts, weights, inner=400)[0]
        assert np.abs(sj.infer(kinds, counts, weights)[0] - done).max() < 0.1
        longer = sj.infer(np.pad(kinds, ((0, 0), (0, 9))), np.pad(counts, ((0, 0), (0, 9))), weights, inner=400)[0]
        assert np.allclose(longer, done, atol=1e-4)


def test_rounds_end_where_the_likelihood_stands(spark, tables, monkeypatch):
    bags = tables["documents"].select("doc_id", "text").limit(80).mapInArrow(sj._bags, sj._BAG)
    samples = [(r.subject, r.text) for r in tables["subject_samples"].collect()]
    made = []
    monkeypatch.setattr(sj, "topics", lambda c, real=sj.topics: made.append(1) or real(c))
    sj.fit(bags, samples, sorted({s for s, _ in samples}), rounds=50)
    assert 3 < len(made) < 30


def test_mapping_by_top_terms():
    samples = [("a", "alfa beta gamma delta"), ("a", "alfa beta gamma delta"), ("b", "jeden dwa trzy cztery"), ("b", "jeden dwa trzy cztery")]
    weights = np.full((sj.BUCKETS, 3), 1e-6)
    for k, text in enumerate(("jeden dwa trzy cztery", "alfa beta gamma delta")):
        weights[[w for s in sj.sentences(text) for w in s], k] = 0.2
    assert sj.map_topics(weights, samples, ["a", "b"])[:2] == [1, 0]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "subject_areas", "subject_samples")}


def test_held_out_samples(spark, tables):
    train = tables["subject_samples"].filter("sample_id % 2 = 0")
    held = tables["subject_samples"].filter("sample_id % 2 = 1").selectExpr("sample_id as doc_id", "text", "lang as subject")
    want = {r.sample_id: r.subject for r in tables["subject_samples"].filter("sample_id % 2 = 1").collect()}
    docs = held.unionByName(tables["documents"].selectExpr("-doc_id - 1 as doc_id", "text", "lang as subject"))
    got = {}
    for r in sj.document_subjects(docs, tables["subject_areas"], train, rounds=2).filter("doc_id > 0").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == {s} for i, s in want.items()) >= 0.95 * len(want)


def test_paragraphs_and_passing_mentions(spark, tables):
    texts = {r.sample_id: (r.subject, r.text) for r in tables["subject_samples"].filter("lang = 'pl'").collect()}
    by = {}
    for i, (s, t) in sorted(texts.items()):
        by.setdefault(s, []).append(t)
    rows = [(1, by["law"][0] + "\n" + by["sport"][0], "x"), (2, by["law"][1] + " W budynku obok działa basen, a po sąsiedzku piekarnia.", "x"), (3, None, "x"), (4, "", "x"), (5, " \n", "x"), (6, "12 ab !", "x"), (7, by["health"][0] * 300, "x"), (2, by["law"][1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    got = sorted(tuple(r) for r in sj.document_subjects(df.unionByName(tables["documents"].selectExpr("doc_id + 100 as doc_id", "text", "lang as subject")), tables["subject_areas"], tables["subject_samples"], rounds=2).filter("doc_id < 100").collect())
    assert got == [(1, "law"), (1, "sport"), (2, "law"), (2, "law"), (7, "health")]


def test_empty_tables(spark, tables):
    docs, areas, samples = (tables[t] for t in ("documents", "subject_areas", "subject_samples"))
    for args in ((docs.limit(0), areas, samples), (docs, areas.limit(0), samples), (docs, areas, samples.limit(0))):
        out = sj.document_subjects(*args)
        assert out.columns == ["doc_id", "subject"] and out.count() == 0
