"""Website ranking and confirmation, review pairs, and portals with pages of their own."""

import json
import random
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from vacantia.discover import websites
from vacantia.resolve import review
from vacantia.sources import portal_pages


def test_search_scores(spark):
    rows = [
        (1, "Acme Budowa Sp. z o.o.", "Łódź", "Acme Budowa - kontakt", "Firma z Łodzi, Łódź", "https://www.acmebudowa.example/", 0.98), (2, "Acme Budowa", None, "Inna", "nic", "https://facebook.com/acme", 0.0), (3, "Acme Budowa", None, "Inna", "nic", "https://pl.linkedin.com/acme", 0.0),
        (4, "Sp. z o.o.", None, "x", "y", "https://x.example", 0.0), (5, "Acme Budowa", None, "Acme", "", "https://other.example", 0.31), (6, "Acme", None, None, None, None, 0.0),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "company_id int, name string, city string, title string, snippet string, url string")
    got = {r.company_id: r.s for r in df.select("company_id", websites.search_score(*[F.col(c) for c in ("name", "city", "title", "snippet", "url")]).alias("s")).collect()}
    assert all(abs(got[r[0]] - r[6]) < 1e-9 for r in rows), got
    assert [(r.company_id, r["rank"]) for r in websites.ranked_candidates(df).collect()] == [(1, 1)]


def test_confirmation(spark):
    data = json.dumps({"@graph": [{"@type": "Organization", "name": "Acme Budowa S.A.", "url": "https://acme.example", "address": {"addressLocality": "Łódź"}, "taxID": "1"}]})
    pages = [("a", f"<p>Acme Budowa, Łódź</p><script type='application/ld+json'>{data}</script>"), ("a", "<p>Kontakt</p>"), ("b", "<p>nic</p>"), ("d", None)]
    attempts = [("a", "Acme Budowa Sp. z o.o.", "Łódź", "https://www.acme.example", 0.9), ("b", "Acme Budowa", "Łódź", "https://b.example", 0.9), ("c", "Acme", None, "https://c.example", 0.8), ("d", "Acme", None, "https://c.example", 0.8)]
    got = {r.attempt: r for r in websites.confirm(spark.createDataFrame(attempts, "attempt string, name string, city string, url string, search_score double"), spark.createDataFrame(pages, "attempt string, html string")).collect()}
    assert got["a"].accepted and got["a"].content_score == 1.0 and abs(got["a"].score - (0.42 * 0.9 + 0.58)) < 1e-9 and set(got["a"].signals) == {"exact_name", "name_in_host", "city", "structured_name", "structured_host", "structured_city", "tax_number"}
    assert not got["b"].accepted and abs(got["b"].score - 0.42 * 0.9) < 1e-9
    assert all(not got[k].accepted and abs(got[k].score - 0.28) < 1e-9 and got[k].signals == ["no_pages"] for k in "cd")


def test_review_pairs(spark):
    names = ["acme budowa", "acme budowy", "acme", "beta transport", "beta transporty", "gamma", "acme budowa lodz"]
    rows = [(i, n, "lodz" if i % 2 else "radom", f"https://{n.split()[0]}.example", 0.9, 0.9) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id bigint, name string, city string, website_url string, website_confidence double, confidence double")
    keys = {}
    for r in review.keys_of(df).collect():
        keys.setdefault(r.key, set()).add(r.id)
    want = {p for ids in keys.values() for p in combinations(sorted(ids), 2)}
    pairs = review.blocked_pairs(df)
    assert {tuple(r) for r in pairs.collect()} == want
    assert {tuple(r) for r in review.blocked_pairs(df, block=2).collect()} <= want
    got = {(r.id_a, r.id_b): r for r in review.scored_pairs(df, pairs).collect()}
    assert (0, 1) in got and got[0, 1].same_website and got[0, 1].score >= 0.9 and (2, 5) not in got


def test_large_keys_keep_all_pairs(spark):
    names = [f"acme {w}" for w in ("budowa", "budowy", "budowa")] + [f"{w} acme" for w in ("zeta", "dolny", "wielki", "maly")] + ["beta"]
    rows = [(i, n, f"miasto{i}", None, None, 0.9) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id bigint, name string, city string, website_url string, website_confidence double, confidence double")
    whole = sorted(map(tuple, review.blocked_pairs(df).collect()))
    assert whole == sorted(combinations(range(7), 2))
    assert sorted(map(tuple, review.blocked_pairs(df, block=1).collect())) == sorted(map(tuple, review.blocked_pairs(df, block=2).collect())) == whole
    scored = {(r.id_a, r.id_b): r.score for r in review.scored_pairs(df, review.blocked_pairs(df, block=2)).collect()}
    assert scored[0, 2] == 1.0 and (0, 3) not in scored


def test_pairs_of_many_keys_meet_once_and_are_not_shuffled(spark):
    words = [a + b for a in ("kowa", "lube", "masz", "nord", "opta", "pola", "rana", "sten", "tarn", "wild") for b in ("bud", "lex", "mer", "pol", "rem", "tor", "wex", "zam")]
    names = [f"{words[i * 7 % 80]} {words[i * i % 80]} {words[(3 * i + i // 9) % 80]}" for i in range(300)]
    rows = [(i, n, None, f"https://h{i % 40}.example", 0.9, 0.9) for i, n in enumerate(names)] + [(None, names[0], None, None, None, None), (5, "kowabud inna", None, None, None, 0.9)]
    df = spark.createDataFrame(rows, "id bigint, name string, city string, website_url string, website_confidence double, confidence double")
    keys = {}
    for r in review.keys_of(df.filter("id is not null")).collect():
        keys.setdefault(r.key, set()).add(r.id)
    assert sum(len(ids) > 1 for ids in keys.values()) > 2 * review.HOT
    want = sorted({p for ids in keys.values() for p in combinations(sorted(ids), 2)})
    for block in (200, 3):
        pairs = review.blocked_pairs(df, block=block)
        assert sorted(map(tuple, pairs.collect())) == want
        plan = pairs._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert not any(x in plan[: plan.index("SortMergeJoin")] for x in ("Exchange", "Aggregate"))
    assert review.blocked_pairs(df.limit(0)).count() == 0


def test_pairs_that_cannot_score_are_left_out_where_they_meet(spark):
    rng = random.Random(4)
    core = lambda: "".join(rng.choice(["ka", "lo", "mar", "te", "wan", "ł", "01", "😀"]) for _ in range(rng.randrange(1, 5)))
    names = ["", " ", "a", "aaaaaaaaaaaa", "przedsiebiorstwo"] + [" ".join(["przedsiebiorstwo", rng.choice(["handlowe", "uslugowe"]), *(core() for _ in range(rng.randrange(1, 3)))][rng.randrange(2) :]) for _ in range(150)]
    names += [n[:-1] + rng.choice("abz") for n in names[5:35]] + [" ".join(reversed(n.split())) for n in names[35:50]]
    rows = [(i, n, rng.choice([None, "", "lodz", "radom"]), rng.choice([None, "https://a.example", f"https://h{i % 9}.example"]), rng.choice([None, 0.5, 0.9]), rng.choice([None, 0.5, 0.9])) for i, n in enumerate(names)] + [(7, "kola przedsiebiorstwo", None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, name string, city string, website_url string, website_confidence double, confidence double")
    whole = review.blocked_pairs(df)
    want = sorted(map(tuple, review.scored_pairs(df, whole).collect()))
    likely = review.likely_pairs(df, block=20)
    assert len(want) > 50 and sorted(map(tuple, review.scored_pairs(df, likely).collect())) == want
    assert len(want) <= likely.count() < whole.count() / 3
    assert review.likely_pairs(df, least=0.0).count() == whole.count()


def test_similarity_is_that_of_the_standard_library():
    rng = random.Random(6)
    for i in range(3000):
        a, b = ("".join(rng.choice("abc d"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(230 if i % 40 == 0 else 15))) for _ in "ab")
        assert review.similarity(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_review_queries_keep_frequent_words_of_any_city(spark, tmp_path):
    from vacantia.plans import relational_queries as rq

    rows = [(i, "hurtownia kowalex", f"miasto{i}", None, 0.0, 0.9) for i in range(30)]
    spark.createDataFrame(rows, "id bigint, normalized_name string, normalized_city string, website_url string, website_confidence double, identity_confidence double").write.parquet(str(tmp_path / "companies.parquet"))
    assert rq.QUERIES["review_all_block_pairs"](spark, str(tmp_path)).count() == 30 * 29 // 2
    assert rq.QUERIES["review_scored_pairs"](spark, str(tmp_path)).count() == 30 * 29 // 2


def test_embedded_state():
    ads = [{"id": 1, "title": "T", "url": "/d/1", "companyName": "C", "location": {"pathName": "Łódź, PL"}, "description": "a<br>b &amp; c"}, {"id": 1, "title": "T", "url": "/d/1"}, {"id": 2, "title": "T", "url": "/d/2"}, {"id": 3}]
    state = json.dumps(json.dumps({"listing": {"listing": {"ads": ads}}}))
    got = portal_pages.state_postings("u", f"<script>window.__PRERENDERED_STATE__= {state};</script>")
    assert [(p["source_id"], p["company_name_confidence"], p["city"]) for p in got] == [("1", 0.96, "Łódź"), ("2", 0.0, None)] and got[0]["url"] == "https://www.olx.pl/d/1" and got[0]["description"] == "a b & c"
    assert portal_pages.state_postings("u", "<p>") == [] and portal_pages.state_postings("u", "window.__PRERENDERED_STATE__= {x};") == []


def test_announcements_and_labels(spark):
    a = "<title>Referent | Urząd Miasta | Praca w służbie cywilnej</title><div>Urząd Skarbowy</div><div>wróć do listy</div><p>Ogłoszenie nr 12345 / 05.03.2025</p><h1>Referent</h1>"
    b = "<h2>Praca</h2><h1>Koordynator</h1><p>Łódź</p><p>3 marca 2025</p><b>Ogłoszeniodawca:</b><p>Fundacja X</p><b>Strona internetowa:</b><a href='https://x.example'>https://x.example</a>"
    df = spark.createDataFrame([("kprm", "https://k.example/kprm/lodz-miasto/x,1,v7", a), ("ngo", "https://n.example/ogloszenie/77", b), ("ngo", "https://n.example/77", "<h1>x</h1>"), ("kprm", None, a), ("olx", "u", None)], "source string, url string, body string")
    got = {r.source: r for r in portal_pages.portal_postings(df).collect()}
    assert (got["kprm"].source_id, got["kprm"].company_name, got["kprm"].city, got["kprm"].published_at) == ("12345", "Urząd Skarbowy", "Lodz Miasto", "2025-03-05")
    assert (got["ngo"].source_id, got["ngo"].company_name, got["ngo"].city, got["ngo"].published_at, got["ngo"].company_website_candidates[0].url) == ("77", "Fundacja X", "Łódź", "2025-03-03", "https://x.example")


def test_structured_portals_and_their_stand_ins():
    read = portal_pages.READERS
    data = json.dumps({"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "Acme"}})
    (a,) = read["aplikuj"]("https://a.example/oferta/12/x", f"<script type='application/ld+json'>{data}</script><p>Dodana 3 marca 2025</p><p>NIP: 1234567890</p>")
    assert (a["source_id"], a["company_name"], a["published_at"], a["company_identifiers"][0]["value"]) == ("12", "Acme", "2025-03-03", "1234567890")
    (m,) = read["manpower"]("https://m.example/pl/job/7/x", "<h1>Magazynier</h1><p>Lokalizacja</p><p>Radom, PL</p><p>Posted: 1 maja 2025</p>")
    assert (m["company_name_confidence"], m["city"], m["published_at"], m["company_website_candidates"][0]["confidence"]) == (0.98, "Radom", "2025-05-01", 1.0)
    (r,) = read["randstad"]("https://r.example/znajdz-prace/x_9/", "<h1>Spawacz</h1><p>Gdynia</p><p>opublikowano 2 czerwca 2025</p>")
    assert (r["source_id"], r["company_name_confidence"], r["city"], r["published_at"]) == ("9", 0.35, "Gdynia", "2025-06-02")
    assert read["randstad"]("https://r.example/x", "<h1>Spawacz</h1>") == [] and read["aplikuj"]("https://a.example/oferta/1/x", "<p>x") == []
    offer = {"props": {"offer": {"id": 5, "subject": {"name": "Fizyka"}, "rspo": {"name": "SP 1", "city": "Łódź", "website": "sp1.example"}, "contact": "c", "offer": "o"}}}
    (o,) = read["ofertypracyedu"]("https://o.example/oferty/5", f"<div id=app data-page='{json.dumps(offer)}'></div>")
    assert (o["source_id"], o["title"], o["description"], o["company_website_candidates"][0]["url"]) == ("5", "Fizyka", "o\n\nc", "https://sp1.example")
    assert read["ofertypracyedu"]("u", "<div id=app data-page='{'></div>") == []


def test_employer_profiles(spark):
    from vacantia.sources import employer_profiles as ep

    rocket, career, skill = (ep.PROFILES[k] for k in ("rocketjobs", "karierawfinansach", "skillshot"))
    assert ep.profile_link(rocket, "https://rocketjobs.pl/o/1", "<a href='/brands/story/own'>O nas</a><a href='/brands/story/acme?x=1'>Zobacz  profil firmy</a>", "Acme") == "https://rocketjobs.pl/brands/story/acme"
    assert ep.profile_link(rocket, "https://rocketjobs.pl/o/1", "<a href='/brands/story/own'>O nas</a>", "Acme") is None
    assert ep.profile_link(skill, "https://www.skillshot.pl/jobs/1", "<a href='/users/x'>a</a><a href='/users/7'>b</a>", "Acme") == "https://www.skillshot.pl/users/7"
    page = '<a href="https://acme.example/">x</a><script>{\\"link\\":\\"https://acme.example/\\",\\"type\\":\\"Website\\"}</script>'
    assert ep.profile_website(rocket, "https://rocketjobs.pl/b", page) == "https://acme.example/" and ep.profile_website(rocket, "https://rocketjobs.pl/b", page.split("</a>")[1]) is None
    assert ep.profile_website(career, "https://www.karierawfinansach.pl/p", "<a href='https://m.karierawfinansach.pl'>x</a><a href='https://www.facebook.com/a'>f</a><a href='https://acme.example'>a</a>") == "https://acme.example"
    assert ep.profile_website(skill, "https://www.skillshot.pl/users/7", "<p>CV: <a href='https://ats.example'>x</a></p><p>Strona: <a href='https://acme.example'>x</a></p>") == "https://acme.example"
    df = spark.createDataFrame([("skillshot", "https://www.skillshot.pl/jobs/1", "<a href='/users/7'>b</a>", None), ("zz", "u", "b", "c"), ("skillshot", None, None, None)], "source string, url string, body string, company_name string")
    assert [r.profile_url for r in ep.profile_links(df).collect()] == ["https://www.skillshot.pl/users/7"]
    assert ep.profile_websites(df.limit(0)).count() == 0


def test_all_sources_share_one_schema(spark):
    from vacantia.schemas import POSTING_COLUMNS
    from vacantia.sources import registry

    df = spark.createDataFrame([("jooble", "u", json.dumps({"jobs": [{"id": 5, "title": "T", "link": "u", "company": "C"}]})), ("randstad", "https://r.example/znajdz-prace/x_9/", "<h1>Spawacz</h1>"), ("nobody", "u", "x"), ("olx", "u", None)], "source string, url string, body string")
    out = registry.postings(df)
    assert out.columns == POSTING_COLUMNS and sorted(r.source for r in out.collect()) == ["jooble", "randstad"]
    assert registry.sources_frame(spark).count() == len(registry.SOURCES)
