"""Groups by union-find against a plain union-find, at every way of splitting the work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import identifier_groups, union_find


def plain(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_local_forest_on_paths_stars_and_random_graphs():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 30), (2000, 1500), (3000, 3000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = {k: v for k, v in plain([(x, y) for x, y in zip(a.tolist(), b.tolist())]).items() if k != v}
        child, root = union_find.local_forest(a, b)
        assert dict(zip(child.tolist(), root.tolist())) == want
    path = np.arange(5000)
    child, root = union_find.local_forest(path[:-1], path[1:])
    assert len(child) == 4999 and not root.any()


@pytest.mark.parametrize("per_task", [1_000_000, 40])
def test_components_with_nulls_loops_repeats_and_long_paths(spark, per_task):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    pairs += [(5, 5), (None, 3), (4, None), (9000, 9000)] + pairs[:20] + [(b, a) for a, b in pairs[:10]]
    df = spark.createDataFrame([(a, b, 0) for a, b in pairs], "a bigint, b bigint, group_id int").repartition(7)
    got = {r.node: r.group_id for r in union_find.components(df, per_task=per_task).collect()}
    assert got == plain(pairs)


def test_no_edges_no_rows(spark):
    df = spark.createDataFrame([], "a bigint, b bigint")
    assert union_find.components(df).count() == 0
    assert union_find.tied_groups(df, F.col("a"), F.col("b")).count() == 0


@pytest.mark.parametrize("per_task", [1_000_000, 30])
def test_tied_groups_with_one_hot_key(spark, per_task):
    rng = np.random.default_rng(3)
    rows = [(int(c), f"k{k}") for c, k in zip(rng.integers(0, 400, 300), rng.integers(0, 250, 300))]
    rows += [(i, "hot") for i in range(1000, 1150)] + [(None, "k1"), (7, None), (1149, "long" * 20000), (8888, "long" * 20000)]
    by = {}
    for c, k in rows:
        if c is not None and k is not None:
            by.setdefault(k, []).append(c)
    want = plain([(cs[0], c) for cs in by.values() for c in cs[1:]])
    df = spark.createDataFrame(rows + rows[:50], "company_id bigint, key string").repartition(5)
    got = {r.node: r.group_id for r in union_find.tied_groups(df, F.col("company_id"), F.col("key"), per_task).collect()}
    assert got == want


@pytest.mark.parametrize("per_task", [1_000_000, 300])
def test_keys_over_many_chunks_of_one_partition(spark, monkeypatch, per_task):
    """Each key on two records that no task and no chunk holds both of."""
    monkeypatch.setattr(union_find, "CHUNK", 50)
    n = 1500
    rows = [(i, f"k{i}") for i in range(n)] + [(n + i, f"k{(i * 7919) % n}") for i in range(n)]
    df = spark.createDataFrame(rows, "r bigint, key string").coalesce(1)
    got = {r.node: r.group_id for r in union_find.tied_groups(df, F.col("r"), F.col("key"), per_task).collect()}
    assert got == {**{i: i for i in range(n)}, **{n + i: (i * 7919) % n for i in range(n)}}


def test_salted_roots_and_contraction_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(union_find, "HOT", 20)
    monkeypatch.setattr(union_find, "HOT_ROOTS", 1_000)
    rng = np.random.default_rng(8)
    pairs = [(5000, i) for i in range(900)] + [(i, i + 1) for i in range(6000, 6700)] + [(int(a), int(b)) for a, b in rng.integers(10_000, 10_800, (700, 2))] + [(-5, -9), (2**62, -(2**62))]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(6, "a", "b")
    got = {r.node: r.group_id for r in union_find.components(df, per_task=64).collect()}
    assert got == plain(pairs)


def test_identifier_keys(spark):
    cases = [
        ("nip", "PL 213 315 21 80", "nip:2133152180"), ("NIP ", "213-315-21-80", "nip:2133152180"), ("regon", "PL5099856094", None),
        ("regon", " (502185255)", "regon:502185255"), ("krs", "nr 0927323439", "krs:0927323439"), ("krs", "brak", None), ("nip", None, None), (None, "2133152180", None),
        ("nip", "111-111-11-11", None), ("nip", "1234567890", None), ("regon", "123456789", None), ("krs", "0000000000", None), ("nip", "9876543210", None), ("nip", "", None),
        ("pracomat_employer_profile", "https://WWW.PRACOMAT.EXAMPLE/Pracodawca/1526/?strona=2", "pracomat_employer_profile:www.pracomat.example/Pracodawca/1526"),
        ("PRACOMAT_EMPLOYER_PROFILE", "http://www.pracomat.example/Pracodawca/1526#opis", "pracomat_employer_profile:www.pracomat.example/Pracodawca/1526"),
        ("ofertnik_employer_profile", "brak", None), ("ofertnik_employer_profile", "", None), ("other", "2133152180", None),
    ]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, value string")
    got = df.select("i", identifier_groups.identifier_key(F.col("kind"), F.col("value")).alias("key")).orderBy("i").collect()
    assert [r.key for r in got] == [c[2] for c in cases]
