"""Scalar functions: text, addresses, identifiers, rounding, classification."""

import random

import pytest
from pyspark.sql import functions as F

from vacantia.functions import identifiers, rounding, text, urls
from vacantia.rules.classify import classified, classify, has_discovery_signal, mailbox_purpose


@pytest.mark.parametrize("raw,want", [
    ("  Zażółć Gęślą-Jaźń  ", "zazolc gesla jazn"), ("ŁÓDŹ", "lodz"), ("", ""), ("!!!", ""), ("Ünïcödé 12", "unicode 12"),
])
def test_fold(spark, raw, want):
    assert text.fold_text(raw) == want
    assert spark.range(1).select(text.folded(F.lit(raw)).alias("x")).first().x == want


@pytest.mark.parametrize("raw,want", [
    ("Acme Sp. z o.o.", "acme"), ("ACME SPÓŁKA Z OGRANICZONĄ ODPOWIEDZIALNOŚCIĄ", "acme"), ("Acme S.A. Sp. k.", "acme"), ("Acme GmbH", "acme"), ("S.A.", ""), ("Sp. s.a. z o.o. Acme", "acme"), ("Sampo", "sampo"), ("alfa spolka s sa c akcyjna j alfa", "alfa j alfa"),
])
def test_firm_names(spark, raw, want):
    assert text.firm_name(raw) == want
    row = spark.createDataFrame([(raw,), (None,)], "n string").select(text.firm_names("n").alias("a"), text.without_legal_forms(text.folded(F.col("n"))).alias("b")).collect()
    assert [row[0].a, row[0].b] == [want, want] and row[1].a is None and row[1].b is None


@pytest.mark.parametrize("raw,base,want", [
    ("HTTPS://Example.COM:443/a?utm_source=x&b=2&a=1#f", None, "https://example.com/a?b=2&a=1"), ("/kontakt", "https://a.example/x", "https://a.example/kontakt"), ("http://a.example:8080/", None, "http://a.example:8080/"),
    ("mailto:x@a.example", None, None), ("https://u:p@a.example/", None, None), ("", None, None), (None, None, None), ("https://a.example:99999/", None, None), ("http://a.example.:80?q=", None, "http://a.example?q="),
])
def test_canonical_urls(raw, base, want):
    assert urls.canonical_url(raw, base) == want


def test_hosts_and_candidates(spark):
    df = spark.createDataFrame([("https://WWW.A.example:8/x",), ("a.example/x",), ("nothing",), (None,), ("http://u@b.example/",)], "u string")
    got = df.select(urls.host_of(F.col("u")).alias("h"), urls.website_candidates("u").alias("c")).collect()
    assert [r.h for r in got] == ["a.example", None, None, None, "b.example"]
    assert [r.c.host for r in got] == ["a.example", "a.example", None, None, "b.example"]
    assert urls.profile_identifier("HTTP://A.example/p/1/?x#y") == "http://a.example/p/1" and urls.profile_identifier(" Abc  D ") == "abc d" and urls.profile_identifier("x") is None


def test_identifiers(spark):
    cases = [("nip", "PL 521-301-72-28", "5213017228"), ("regon", "12345678901234", "12345678901234"), ("regon", "12", None), ("krs", "0000012345", "0000012345"), ("other", " A  b ", "a b"), ("other", "x", None), ("nip", None, None)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, k string, v string")
    assert [r.x for r in df.orderBy("i").select(identifiers.identifier_value(F.col("k"), F.col("v")).alias("x")).collect()] == [c[2] for c in cases]


def test_rounding_is_binary(spark):
    df = spark.createDataFrame([(1 / 32,), (3 / 20000,), (9 / 160,), (None,)], "x double")
    assert [r.y for r in df.select(rounding.rounded4("x").alias("y")).collect()] == [0.0312, 0.0001, 0.0563, None]


CONTEXTS = [
    ("Zapraszamy do współpracy", "biuro@a.example", ("business_partnership", "green", 0.95, "zapraszamy do wspolpracy")), ("Nie przyjmujemy ofert handlowych, oferty handlowe", "", ("negative", "ignore", 0.99, "nie przyjmujemy ofert handlowych")),
    ("Kontakt RODO, oferty handlowe", "", ("privacy", "ignore", 0.98, "privacy")), ("Kariera i praca", "oferty@a.example", ("recruitment", "ignore", 0.94, "recruitment")), ("Napisz", "oferty@a.example", ("sales", "review", 0.82, "localpart:oferty")),
    ("Kontakt dla firm", "b2b@a.example", ("business_partnership", "green", 0.95, "kontakt dla firm")), ("Kontakt dla firm", "biuro@a.example", ("business_partnership", "review", 0.72, "dla firm")), ("Reklamacje", "", ("support", "ignore", 0.9, "support")),
    ("Kontakt", "", ("generic", "review", 0.4, "generic")), ("https://a.example/wspolpraca kontakt", "x@a.example", ("business_partnership", "review", 0.72, "wspolpraca")), ("Współpracownik pracami", "", ("generic", "review", 0.4, "generic")),
]


def test_classification_in_python_and_as_columns(spark):
    for context, value, want in CONTEXTS:
        assert classify(context, value) == want, context
    rng = random.Random(1)
    words = ["Oferty", "handlowe", "RODO", "rekrutacja", "cv", "kontakt dla firm", "B2B", "pomoc", "hr@x.example", "żółć", "sprzedaż", "zgoda na informacje handlowe", "franczyza", "partner"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(5))), rng.choice(["", "partnerzy.pl@a.example", "jan@a.example", "https://a.example/kontakt-dla-firm"])) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, c string, v string").select("i", classified(F.col("c"), F.col("v")).alias("a"), classified(F.col("c"), F.col("v"), form=True).alias("f")).collect()
    for r in df:
        _, c, v = rows[r.i]
        assert tuple(r.a) == classify(c, v) and tuple(r.f) == classify(c, v, form=True), (c, v)


def test_mailboxes_and_signals():
    assert mailbox_purpose("Wspolpraca.B2B@a.example") == ("business_partnership", "wspolpracab2b") and mailbox_purpose("jan@a.example") is None and mailbox_purpose("sales") is None
    assert has_discovery_signal("Zostań partnerem") and not has_discovery_signal("Kontakt")
