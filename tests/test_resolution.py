"""The fold of postings into firms: worked orders, and parts against one sequential fold."""

import random

import pytest

from vacantia.functions.text import firm_name, fold_text
from vacantia.resolve import fold
from vacantia.resolve.decide import Firm, decide, is_distinctive

SCHEMA = "id bigint, source string, source_id string, url string, company_name_raw string, city string, company_name_confidence double, company_name_source string, strong string, part string"


def firm(name, city, confidence=0.9):
    return Firm(1, "k", name, name, city, city, None, confidence)


def test_decisions():
    a, b = firm("acme polska", "lodz"), firm("acme polska", "radom")
    assert decide("acme polska", "lodz", 0.1, [a, b])[1:] == ("exact_name_city", 1.0)
    assert decide("acme polska", None, 0.9, [a, b])[1:] == ("ambiguous_exact_name", 0.9)
    assert decide("acme polska", "gdynia", 0.9, []) == (None, "new_company", 0.9)
    assert decide("acme polska", "gdynia", 0.7, [a])[1:] == ("insufficient_cross_city_evidence", 0.7)
    assert decide("acme polska", "gdynia", 0.9, [a]) == (a, "exact_name_cross_city", 0.88)
    assert decide("acme polska", None, 0.9, [a]) == (a, "exact_name_partial_location", 0.92)
    assert decide("hotel", "gdynia", 0.9, [firm("hotel", "lodz")])[1] == "insufficient_cross_city_evidence"
    assert is_distinctive("ab cde") and not is_distinctive("ab cd") and not is_distinctive("firma") and not is_distinctive("")


def rows_of(seed, n, strong):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = rng.choice(["Acme Polska", "Acme Polska Sp. z o.o.", "Hotel", "Hotel S.A.", "Beta", "Gamma Delta", "S.A."])
        out.append((i, rng.choice("ab"), rng.choice([None, str(rng.randrange(20))]), f"u{i}", name, rng.choice([None, "", "Łódź", "Radom", "lodz"]), rng.choice([0.5, 0.8, 0.9, 1.0]), "s", rng.choice([None, None, f"nip:{rng.randrange(6)}"]) if strong else None, "clash"))
    return out


def sequential(rows):
    state, out = fold.Fold(), {}
    for i, source, source_id, url, name, city, confidence, named_by, strong, _ in rows:
        place = fold_text(city or "") or None
        got = state.step(i, firm_name(name), name, place, (city or "").strip() or None, confidence, source, source_id or url, named_by, strong)
        out[i] = got
    return out


@pytest.mark.parametrize("strong", [False, True])
def test_parts_fold_like_one_sequence(spark, strong):
    for seed in (1, 2):
        rows = rows_of(seed, 250, strong)
        df = spark.createDataFrame(rows, SCHEMA).repartition(6)
        got = {r.seq: (r.company_seq, r.created, r.method, r.confidence, r.company_key) for r in fold.resolve(df, strong="strong" if strong else None).collect()}
        assert got == sequential(rows)


def test_a_posting_seen_again_without_a_city(spark):
    row = ("a", "1", "u", "Acme Polska", None, 0.5, "s", None, "")
    got = [r.method for r in fold.resolve(spark.createDataFrame([(i, *row) for i in range(5)], SCHEMA)).orderBy("seq").collect()]
    assert got == ["new_company", "insufficient_cross_city_evidence", "ambiguous_exact_name", "stable_source_key", "stable_source_key"]


def test_ids_are_dense_and_in_order(spark):
    r = fold.resolve(spark.createDataFrame(rows_of(3, 200, False), SCHEMA))
    ids = sorted((x.company_seq, x.company_id) for x in fold.firm_ids(r).collect())
    assert [i for _, i in ids] == list(range(1, len(ids) + 1))


def test_empty(spark):
    assert fold.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parts_of_long_chains(spark):
    rows = [(f"n{i:03d}", f"s{i}") for i in range(60)] + [(f"n{i + 1:03d}", f"s{i}") for i in range(60)] + [("z", None), ("y", "t"), ("x", "t")]
    got = {r.name: r.part for r in fold.parts(spark.createDataFrame(rows, "name string, strong string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and (got["z"], got["y"], got["x"]) == ("z", "x", "x")
