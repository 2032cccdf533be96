"""City mapping: the rules on worked cases, nulls and odd tables, and similarity against brute force."""

import random

import pytest

from vacantia.llm import places

ENTRIES = [
    (1, "Klemibórz", "nadborskie"), (2, "Nowy Zelmibrzeg", "łęgowskie"), (3, "Zelmibrzeg", "łęgowskie"), (4, "Stagawice", "wyżnickie"), (5, "Stagawice", "nadborskie"),
    (6, "Grotocin", "rudnieńskie"), (7, "Grotocin Wielki", "rudnieńskie"), (8, "Narzowice", "gajeckie"), (9, "Świnołęka", "gajeckie"), (10, "Nowy Radfebrzeg", "gajeckie"),
    (11, "Radfebrzeg", "modrzańskie"), (12, "Radfebrzeg", "skalbińskie"), (13, "Korbesław Górny", "gajeckie"), (14, "Marlowiec", "gajeckie"), (15, "Odrridół", "gajeckie"),
]
CASES = {
    "Klemibórz": 1, "  KLEMIBORZ ": 1, "99-123 klemibórz": 1, "Klemibórz (woj. nadborskie)": 1, "okolice: Klemibórz": 1, "w Klemiborzu": 1, "Klemibórz / zdalnie": 1, "Klemibórz, ul. Zelmibrzeg 3": 1,
    "klemybórz": 1, "k1emibórz": 1, "Klemibróz": 1, "Klemiibórz": 1, "Nowy Zelmibrzeg": 2, "nowy zlemibrzeg": 2, "Noyw Zelmibrzeg": 2, "Zelmibrzeg, Nowy Dwór": 3, "w Narzowicach": 8, "Świnołęce": 9,
    "Stagawice": 0, "Stagawice (wyżnickie)": 4, "stagawice - nadborskie": 5, "STAGAWICE, WOJ. NADBORSKIE": 5, "Grotocin Wielki": 7, "Grotocin Wuelki": 7, "Grotocin": 6, "grotocinwielki": 7,
    "Klemibórz, Narzowice": 0, "Klemibórz lub Narzowice": 0, "Klemibórz i Klemibórz": 1, "Narzowice; Klemybórz": 0, "nowy radfebrzeg": 10, "Nowyy Radfebrzeg": 10, "Radfebrzeg": 0, "Korbeslaw Gorny": 13, "w Marlowcu": 14, "Odrridole": 15,
    "Warmokępa": 0, "zdalnie": 0, "home office": 0, "-": 0, "n/d": 0, "woj. gajeckie": 0, "123": 0, "x" * 5000: 0, "Klemibórz " + "y" * 5000: 1,
}


def test_rules():
    r = places.Resolver(ENTRIES)
    assert {v: r.resolve(v) for v in CASES} == CASES


MORE = [(21, "Jelenia Góra", "a"), (22, "Nowy Sącz", "a"), (23, "Gorzów Wielkopolski", "b"), (24, "Bydgoszcz", "b"), (25, "Częstochowa", "c"), (26, "Warszawa", "c"), (27, "Poznań", "d"), (28, "Kraków", "e")]


def test_token_sets_edits_and_cases():
    r = places.Resolver(MORE)
    cases = {
        "Góra Jelenia": 21, "Sącz Nowy": 22, "Wielkopolski Gorzów": 23, "wielkopolsky gorzuw": 23, "Bxdgoyzcz": 24, "Częxtoxhowa": 25, "Warszawie": 26, "Poznaniu": 27, "Krakowie": 28, "Bydgoscz " + "okna drzwi " * 30: 24,
        "Warszawski": 0, "Nowy": 0, "Góra": 0, "Poznanianka": 0,
    }
    assert {v: r.resolve(v) for v in cases} == cases


def test_similar_words_against_all_tokens():
    rng = random.Random(7)
    r = places.Resolver(ENTRIES + MORE)
    words = sorted(r.tokens.keys() | r.joined.keys())
    for _ in range(400):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(0, 3)):
            i = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                w[i] = rng.choice("abcdxyz")
            elif kind == 1:
                w.insert(i, rng.choice("abcdxyz"))
            elif kind == 2 and len(w) > 1:
                del w[i]
            elif i:
                w[i - 1], w[i] = w[i], w[i - 1]
        word = "".join(w)
        want = {x: d for x in words if (d := places.within(word, x, places.edits_allowed(word))) is not None}
        got = {x: d for x, d in r.alike(word).items() if d < 3}
        assert got == want, word


def test_empty_reference():
    assert places.Resolver([]).resolve("Klemibórz") == 0


def test_edit_distance_and_index_agree_with_brute_force():
    rng = random.Random(5)
    letters = "abcde"

    def slow(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(2000):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(2))
        assert places.within(a, b, 2) == (slow(a, b) if slow(a, b) <= 2 else None)


def test_records_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "Klemibórz", "x"), (1, "Klemibórz", "x"), (2, None, "x"), (3, " \t", "x"), (4, "Warmokępa", "x"), (None, "Narzowice", "x")]
    df = spark.createDataFrame(rows, "id bigint, city string, city_id string")
    ref = spark.createDataFrame(ENTRIES + ENTRIES[:2] + [(99, None, None)], "city_id bigint, city_name string, region_name string")
    out = places.located_records({"a": df, "b": df.limit(0)}, ref)
    assert out.columns == ["record_table", "record_id", "city_id"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, 1), ("a", 1, 1), ("a", 4, 0), ("a", None, 8)], key=str)
    assert {r.city_id for r in places.located_records({"a": df}, ref.limit(0)).collect()} == {0}


def test_reference_lists_have_a_checked_size(spark, monkeypatch):
    monkeypatch.setattr(places, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError):
        places.reference_entries(spark.createDataFrame(ENTRIES, "city_id bigint, city_name string, region_name string"))
