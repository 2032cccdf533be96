"""Linking spellings: readings of names, the sparse join and average linkage against brute force, whole tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import names
from vacantia.llm.name_parts import Name, read_name


@pytest.mark.parametrize("raw,want", [
    ("Lamderalot Konstr. Stal. sp. j.", Name("lamderalot", ("steel",), (), "")),
    ("Lamderalot Steel Structures", Name("lamderalot", ("steel",), (), "")),
    ("„Lubb-Osorex Systemy Grzewcze s.c.”", Name("lubbosorex", ("heating",), (), "")),
    ("P.H.U. Krzysztof Nardowawczyk", Name("nardowawczyk", (), ("phu",), "krzysztof")),
    ("Nardowawczyk Krzysztof Przedsiębiorstwo Handlowo-Usługowe", Name("nardowawczyk", (), ("phu",), "krzysztof")),
    ("Usługi Remontowe Zosia Malzodelniak / biuro kadr", Name("malzodelniak", (), ("ur",), "zofia")),
    ("Usługi Remontowe Z. Malzodelniak", Name("malzodelniak", (), ("ur",), "z")),
    ("ZA1DITESTAN KLUB SPORTOWY SP Z OO", Name("zalditestan", ("sport",), (), "")),
    ("www.pertetokar.example", Name("pertetokar", (), (), "")), ("Nargolizan Spółka Akcyjna", Name("nargolizan", (), (), "")), ("", Name("", (), (), "")),
])
def test_readings(raw, want):
    assert read_name(raw) == want


def test_very_long_names():
    assert len(read_name("Abc " * 3000).core) == 9000


def cosine_of(spark, cores):
    """Cosines by plain arithmetic, with frequencies counted in the same buckets."""
    grams = {c: {f"^{c}$"[i : i + names.GRAM] for i in range(max(1, len(c) + 3 - names.GRAM))} for c in cores}
    rows = spark.createDataFrame([(x,) for x in sorted(set().union(*grams.values()))], "g string").select("g", F.pmod(F.hash("g"), F.lit(names.BUCKETS[names.GRAM])).alias("b")).collect()
    bucket = {r.g: r.b for r in rows}
    df = Counter(b for g in grams.values() for b in {bucket[x] for x in g})
    w = {x: math.log(len(cores) / df[b]) + 1 for x, b in bucket.items()}
    norm = {c: math.sqrt(sum(w[x] ** 2 for x in g)) for c, g in grams.items()}
    return lambda a, b: sum(w[x] ** 2 for x in grams[a] & grams[b]) / norm[a] / norm[b]


def test_sparse_join_finds_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    cores = {"".join(rng.choice(["kra", "lo", "mar", "te", "wan", "x", "stal"]) for _ in range(rng.randrange(1, 5))) for _ in range(150)} | {"a", "abcd", "abce"}
    cos = cosine_of(spark, cores)
    df = spark.createDataFrame([(c, 1) for c in sorted(cores)] * 2, "core string, gram int")
    got = {(r.c1, r.c2): r.cosine for r in names.linked_cores(df).collect()}

    want = {(a, b): cos(a, b) for a in cores for b in cores if a < b and cos(a, b) >= names.COSINE + 1e-4}
    assert len(want) > 20 and set(want) <= set(got) and all(abs(got[k] - cos(*k)) < 1e-4 and got[k] >= names.COSINE - 1e-9 for k in got)
    pairs = {("kowalskinowacki", "nowackikowalski"), ("balticwindenergy", "energybalticwind"), ("budex", "budexinwest")}
    few = spark.createDataFrame([(c,) for c in {x for p in pairs for x in p} | {f"{a}{b}" for a in ("kel", "tor", "zam") for b in ("wo", "luk", "pir")}], "core string")
    monkeypatch.setattr(names, "COSINE", 0.45)
    assert {("kowalskinowacki", "nowackikowalski"), ("balticwindenergy", "energybalticwind")} <= {(r.c1, r.c2) for r in names.linked_cores(few).collect()}


def test_misspelt_cores_are_all_found(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeklmnoprstuw") for _ in range(n)) for n in (5, 6, 7, 8, 9, 10, 11, 12, 14, 41, 43, 60)]

    def typo(c):
        i, letter = rng.randrange(len(c)), rng.choice("abcdeklmnoprstuw")
        return rng.choice([c[:i] + c[i + 1 :], c[:i] + letter + c[i:], c[:i] + letter + c[i + 1 :], c[: i - 1] + c[i : i + 1] + c[i - 1 : i] + c[i + 1 :] if i else c[1:]])

    one = [typo(c) for c in base for _ in range(6)]
    cores = sorted({*base, *one, *(typo(c) for c in one), "marlotemal", "matlotemal", "mrankowar", "marnakowar", "ab", "a"})
    df = spark.createDataFrame([(c,) for c in cores] * 2, "core string")

    def edits(a, b):  # swapped neighbours count as one
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    want = {(a, b): e for a in cores for b in cores if a < b and abs(len(a) - len(b)) < 3 and (e := edits(a, b)) <= 2}
    got = {(r.c1, r.c2): r.edits for r in names._near_by_deletions(df).collect()}
    assert set(want) <= set(got) and all(0 < e <= 4 for e in got.values())
    linked = {(r.c1, r.c2) for r in names.misspelt_cores(df).collect()}
    assert {k for k, e in want.items() if e == 1 and len(k[0]) > 4 and len(k[1]) > 4} <= linked and ("marnakowar", "mrankowar") in linked


def company_clusters(spark, rows):
    c = spark.createDataFrame([(i, n, n.lower(), city, None) for i, n, city in rows], "id bigint, canonical_name string, normalized_name string, city string, website_url string")
    none = spark.createDataFrame([], "company_id bigint, alias string, company_name_raw string")
    cities = spark.createDataFrame([(1, "Jodlełęka", "a"), (2, "Narzowice", "b")], "city_id bigint, city_name string, region_name string")
    out = names.variant_pairs(names.employer_clusters(c, none, none, cities, spark.createDataFrame([], "host string")))
    return {tuple(r) for r in out.collect()}


def test_reordered_parts_and_initials(spark):
    rows = [(1, "Kowalski Nowacki", "Narzowice"), (2, "Nowacki Kowalski", "Narzowice"), (3, "Baltic Wind Energy", "Jodlełęka"), (4, "Energy Baltic Wind", "Jodlełęka"), (5, "BWE", "Jodlełęka"), (6, "BWE", "Narzowice"), (7, "Bardzo Wielki Ekran", "Narzowice")]
    got = company_clusters(spark, rows)
    assert {(1, 2), (3, 4), (6, 7)} <= got and (5, 6) not in got and (3, 7) not in got


def test_common_cores_meet_where_something_else_agrees(spark, monkeypatch):
    rows = [(i, f"{trade} Nowak", city) for i, (trade, city) in enumerate((t, c) for t in ("Transport", "Meble", "Hotele", "") for c in ("Narzowice", "Jodlełęka", "Obce Miasto", ""))]
    plain = company_clusters(spark, rows)
    monkeypatch.setattr(names, "COMMON_NODES", 3)
    assert company_clusters(spark, rows) <= plain


def test_common_cores_keep_all_pairs(spark, monkeypatch):
    """Nodes of a core that all have, of which nothing else agrees, are compared as those of a rare one."""
    nodes = spark.createDataFrame([(i, "", f"place {i}", "", "", "") for i in range(12)], "node bigint, trades string, place string, host string, forms string, person string")
    by_node = spark.createDataFrame([(i, c, c == "xyz") for i in range(12) for c in (["nowak", "xyz"] if i % 4 == 0 else ["nowak"])] + [(3, "nowaks", False), (5, "xyz", False)], "node bigint, core string, initials boolean")
    links = spark.createDataFrame([("nowak", "nowaks", 1), ("nowak", "nowak", 0), ("nowaks", "nowaks", 0), ("xyz", "xyz", 0)], "c1 string, c2 string, edits int")
    plain = sorted(map(tuple, names._candidates(links, by_node, nodes).collect()))
    assert [r[:2] for r in plain] == [(a, b) for a in range(12) for b in range(a + 1, 12)]
    monkeypatch.setattr(names, "COMMON_NODES", 3)
    assert sorted(map(tuple, names._candidates(links, by_node, nodes).collect())) == plain


def test_estimate_finds_what_agreement_says():
    rng = np.random.default_rng(5)
    one = rng.random(20_000) < 0.25
    near = np.where(one, rng.choice(5, 20_000, p=[0.7, 0.2, 0.08, 0.02, 0]), rng.choice(5, 20_000, p=[0.2, 0.1, 0.4, 0.3, 0]))
    levels = []
    for m, u in ((0.95, 0.1), (0.85, 0.02), (0.9, 0.001), (0.9, 0.5), (0.97, 0.1)):
        agrees = rng.random(20_000) < np.where(one, m, u)
        levels.append(np.where(rng.random(20_000) < 0.4, 0, np.where(agrees, 1, 2)))
    patterns, counts = np.unique(np.stack([near, *levels], 1), axis=0, return_counts=True)
    odds, of_near, of_fields = names.estimate(patterns, counts.astype(float))
    assert abs(1 / (1 + np.exp(-odds)) - 0.25) < 0.02 and abs(of_near[0] - np.log(0.7 / 0.2)) < 0.2
    assert abs(of_fields[0][0] - np.log(0.95 / 0.1)) < 0.25 and abs(of_fields[1][1] - np.log(0.15 / 0.98)) < 0.25
    assert names.estimate(np.empty((0, 6), int), np.empty(0))[0] == pytest.approx(np.log(0.3 / 0.7))


def test_rows_tied_by_a_misspelt_name_alone(spark):
    rows = [(1, "Marlotemal", "marlotemal", "Narzowice", None), (2, "Matlotemal", "matlotemal", "Narzowice", None), (3, "Marnakowar", "marnakowar", "Narzowice", None), (4, "Mrankowar", "mrankowar", "Narzowice", None), (5, "Marlotemal", "marlotemal x", "Jodlełęka", None)]
    c = spark.createDataFrame(rows + [(10 + i, w, w, "Jodlełęka", None) for i, w in enumerate(("malotrin", "bratemalin", "kwarlotan", "wotemalex", "rankobit", "narnakol"))], "id bigint, canonical_name string, normalized_name string, city string, website_url string")
    none = spark.createDataFrame([], "company_id bigint, alias string, company_name_raw string")
    cities = spark.createDataFrame([(1, "Jodlełęka", "a"), (2, "Narzowice", "b")], "city_id bigint, city_name string, region_name string")
    clusters = names.employer_clusters(c, none, none, cities, spark.createDataFrame([], "host string"))
    got = {tuple(r) for r in names.variant_pairs(clusters).collect()}
    assert {(1, 2), (3, 4)} <= got and all(a > 4 or b < 5 for a, b in got)


def plain_linkage(nodes, edges, least):
    clusters = {n: [n] for n in nodes}
    weight = {frozenset(e[:2]): e[2] for e in edges}
    mean = lambda a, b: sum(weight.get(frozenset((x, y)), 0) for x in clusters[a] for y in clusters[b]) / len(clusters[a]) / len(clusters[b])
    while True:
        best = max(((round(mean(a, b), 12), -a, -b) for a in clusters for b in clusters if a < b), default=(0,))
        if best[0] < least:
            return {x: c for c, xs in clusters.items() for x in xs}
        a, b = -best[1], -best[2]
        clusters[a] += clusters.pop(b)


def graph(seed, n, m):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(10, 10 + n), 2))) for _ in range(m)}
    return [(a, b, round(rng.random(), 3)) for a, b in sorted(pairs)]


def test_average_linkage_merges_like_one_pair_at_a_time(spark):
    for seed, n, m in ((1, 8, 12), (2, 25, 60), (3, 40, 200), (4, 30, 400)):
        edges = graph(seed, n, m)
        nodes = sorted({x for e in edges for x in e[:2]})
        a, b, w = (np.array(c) for c in zip(*edges))
        got = dict(zip(nodes, names.average_linkage(np.array(nodes), a, b, w, 0.4).tolist()))
        assert got == plain_linkage(nodes, edges, 0.4)
    edges = graph(5, 20, 50)
    joined = {r.node: r.cluster for r in names.linkage_by_joins(spark.createDataFrame(edges, "a bigint, b bigint, weight double"), 0.4).collect()}
    assert joined == plain_linkage(sorted(joined), edges, 0.4)


COMPANIES = [
    (1, "Lamderalot Konstr. Stal.", "lamderalot konstr stal", "Jodlełęka", "http://www.lamderalot.example/pl"), (2, "Lamderalot Konstrukcje Stalowe sp. j.", "lamderalot konstrukcje stalowe", "Jodlełęka, Stare Miasto", None),
    (3, "Lamderallot Steel Structures", "lamderallot steel structures", "Jodlełęka", "{{website}}"), (4, "Lamderalot Piekarnie", "lamderalot piekarnie", "Narzowice", "https://lamderalot-bakeries.example"),
    (5, "Usługi Remontowe Zofia Malzodelniak", "uslugi remontowe zofia malzodelniak", None, None), (6, "UR Zosia Malzodelniak", "ur zosia malzodelniak", "Narzowice", None), (7, "UR Jan Malzodelniak", "ur jan malzodelniak", "Jodlełęka", None),
    (8, None, None, None, None), (9, "", "", "", ""), (10, "UR Zosia Malzodelniak", "ur zosia malzodelniak", "Narzowice", None), (10, "UR Zosia Malzodelniak", "ur zosia malzodelniak", "Narzowice", None),
]


@pytest.mark.parametrize("part_edges", [200_000, 0])
def test_whole_tables(spark, part_edges):
    c = spark.createDataFrame([(*r, "clash", 0.5) for r in COMPANIES], "id bigint, canonical_name string, normalized_name string, city string, website_url string, core string, node double")
    aliases = spark.createDataFrame([(1, "Lamderalot Steel Structures"), (None, "x"), (99, "Nobody")], "company_id bigint, alias string")
    postings = spark.createDataFrame([(2, "LAMDERALOT SP. J."), (2, None)], "company_id bigint, company_name_raw string")
    cities = spark.createDataFrame([(1, "Jodlełęka", "a"), (2, "Narzowice", "b")], "city_id bigint, city_name string, region_name string")
    portals = spark.createDataFrame([("ofertnik.example",)], "host string")
    clusters = names.employer_clusters(c, aliases, postings, cities, portals, part_edges)
    got = sorted(tuple(r) for r in names.variant_pairs(clusters).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (5, 6), (5, 10)]
    assert names.variant_pairs(names.employer_clusters(c.limit(0), aliases, postings, cities, portals)).count() == 0
