"""The catalogue file, the registry's look-ups and the filter by robots files."""

import pytest
from pyspark.sql import functions as F

from vacantia.sources import catalogue, robots


def test_catalogue_file(spark, tmp_path):
    head = "﻿id\tname\turl\tpriority\ttype\tpublic_api\tintegration\n"
    (tmp_path / "c.tsv").write_text(head + "1\t Alfa \thttps://a.example\tP1\tportal\tno\thtml\n2\tBeta\thttps://b.example\tp2\tportal\tyes\tapi\n3\tGama\thttps://g.example\tP1\tportal\tno\t\n", encoding="utf-8")
    c = catalogue.read_catalogue(spark, str(tmp_path / "c.tsv"), {1: "alfa", 9: "x"})
    assert [(r.id, r.name, r.adapter, r.implemented) for r in c.orderBy("id").collect()] == [(1, "Alfa", "alfa", True), (2, "Beta", None, False), (3, "Gama", None, False)]
    assert catalogue.chosen(c, priority=" p1").count() == 2 and catalogue.chosen(c, "P1", True).count() == 1 and catalogue.chosen(c, implemented=False).count() == 2 and catalogue.chosen(c).count() == 3
    assert {(r.priority, r.entries, r.implemented) for r in catalogue.summary(c).collect()} == {("P1", 2, 1), ("p2", 1, 0), (None, 3, 1)}
    (tmp_path / "d.tsv").write_text("id\tname\n1\tx\n")
    with pytest.raises(ValueError):
        catalogue.read_catalogue(spark, str(tmp_path / "d.tsv"))


def test_registry():
    assert catalogue.source(" JOOBLE ").access == "partner_api" and catalogue.missing_settings("adzuna", {"ADZUNA_APP_ID": "x", "ADZUNA_APP_KEY": " "}) == ["ADZUNA_APP_KEY"]
    assert "olx" in catalogue.public_sources() and "jooble" not in catalogue.public_sources()
    with pytest.raises(KeyError):
        catalogue.source("nobody")


def test_same_site(spark):
    rows = [("www.A.example", "a.example", True), ("a.example", "b.a.example", False), (None, None, False), ("", "", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", catalogue.same_site(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_robots(spark):
    rules = "User-agent: *\nDisallow: /private\n"
    answers = spark.createDataFrame([("https://a.example", 200, rules), ("https://b.example", 403, None), ("https://c.example", 404, None), ("https://d.example", 500, None)], "origin string, status int, body string")
    cases = {"https://a.example/x": (True, True), "https://A.example/private/y": (False, False), "https://b.example/": (False, True), "https://c.example/": (True, True), "https://d.example/": (False, True), "https://e.example/": (False, True), "mailto:x": (False, False)}
    urls = spark.createDataFrame([(u, 1) for u in cases] + [(None, 2)], "url string, status int")
    for i, strict in enumerate((True, False)):
        got = {r.url: r.may_fetch for r in robots.allowed(urls, answers, strict=strict).collect()}
        assert got == {**{u: c[i] for u, c in cases.items()}, None: False}
    assert robots.allowed(urls.limit(0), answers).columns == ["url", "status", "may_fetch"]
