"""Pages, structured data, feeds and files on small snippets."""

import base64
import io
import json
import zipfile

from vacantia.html import channels, dom, jsonld
from vacantia.sources import files, json_feeds, pages


def test_tree_and_selectors():
    d = dom.parse("<div class='a b' id=x><p>Jeden<br>dwa<p>trzy<script>no()</script></div><a href='/firmy/1'>F</a>")
    assert d.text() == "Jeden dwa trzy F" and d.select("#x")[0].get("class") == "a b" and d.select("div.b p")[0].text().startswith("Jeden")
    assert [n.text() for n in d.select("a[href*='/firmy/']")] == ["F"] and d.select("[class='zz']") == [] and dom.parse(None).text() == ""


def test_mail_addresses_in_all_guises():
    code = "".join(f"{b ^ 0x42:02x}" for b in b"b2b@a.example")
    html = f"""<p>Zapraszamy do współpracy: <b>biuro@a.example</b></p><li>jan (at) a.example</li><li>ola [małpa] a [kropka] example</li><li>ewa at a dot example</li>
        <a href="mailto:HR@a.example?subject=x">Kariera</a><a href="/cdn-cgi/l/email-protection#42{code}">chronione</a>"""
    got = {c[1]: c for c in channels.channels(html, "https://a.example/kontakt") if c[0] == "email"}
    assert set(got) == {"biuro@a.example", "jan@a.example", "ola@a.example", "ewa@a.example", "hr@a.example", "b2b@a.example"}
    assert got["biuro@a.example"][2:5] == ("business_partnership", "green", 0.95) and got["hr@a.example"][3] == "ignore" and got["b2b@a.example"][2:4] == ("business_partnership", "review")
    assert channels.unprotected("zz") is None and channels.unprotected("") is None


def test_forms_links_and_buttons():
    html = """<form action="/b2b?utm_source=x"><input name="oferty handlowe"></form><form><input placeholder=imie></form><a href="/partnerzy">Zostań partnerem</a><a href="/b2b">Współpraca B2B</a>
        <button>Zostań dostawcą</button><div role=button>nic</div>"""
    got = {c[1]: c for c in channels.channels(html, "https://a.example/x#y") if c[0] == "form"}
    assert got["https://a.example/b2b"][4] == 0.95 and got["https://a.example/partnerzy"][4] == 0.86 and got["https://a.example/x"][2:5] == ("supplier", "green", 0.84)


def test_local_context_beats_the_footer():
    html = "<div><p>Napisz do nas: biuro@a.example</p></div><footer>Polityka RODO</footer>"
    assert channels.channels(html, "https://a.example/")[0][2] == "generic"


JSONLD = {"@graph": [{"@type": ["Thing", "JobPosting"], "title": "Kucharz &amp; kelner", "identifier": {"value": 7}, "hiringOrganization": {"name": "Acme <b>SA</b>", "url": "https://acme.example", "sameAs": ["https://acme.example", "https://x.example"], "identifier": [{"name": "NIP", "value": "123"}, "zz"]}, "jobLocation": [{"address": {"addressRegion": "Woj"}}, {"address": {"addressLocality": "Łódź"}}], "datePosted": "2025-01-01", "description": "<p>Opis</p>"}]}


def test_structured_postings():
    page = dom.parse(f"<script type='application/ld+json'>broken</script><script type='application/ld+json'>{json.dumps(JSONLD)}</script>")
    p = jsonld.job_posting("https://u.example/1", page, "src")
    assert (p["source_id"], p["title"], p["company_name"], p["city"], p["description"]) == ("7", "Kucharz & kelner", "Acme SA", "Łódź", "Opis")
    assert [(i["kind"], i["value"]) for i in p["company_identifiers"]] == [("nip", "123"), ("organization_id", "zz")] and [w["url"] for w in p["company_website_candidates"]] == ["https://acme.example", "https://x.example"]
    assert jsonld.city({"jobLocationType": "TELECOMMUTE"}) == "Remote" and jsonld.job_posting("u", dom.parse("<h1>x</h1>"), "s") is None


def test_portal_pages(spark):
    listing = "<a href='/praca/kucharz,oferta,1?x=1#a'>a</a><a href='/praca/kucharz,oferta,1?x=1'>b</a><a href='https://other.example/praca/a,oferta,2'>c</a><a href='/o-nas'>d</a>"
    detail = "<link rel=canonical href='/praca/kucharz,oferta,1'><h1>Kucharz</h1><a href='/firmy/acme'>Acme</a><main>Opis</main>"
    df = spark.createDataFrame([("theprotocol", "https://theprotocol.it/praca", listing), ("theprotocol", "https://theprotocol.it/p", detail), ("unknown", "u", detail), ("theprotocol", None, None)], "source string, url string, body string")
    assert [r.url for r in pages.listing_links(df).collect()] == ["https://theprotocol.it/praca/kucharz,oferta,1?x=1"]
    (p,) = pages.page_postings(df).collect()
    assert (p.source_id, p.company_name, p.company_name_confidence, p.description) == ("https://theprotocol.it/praca/kucharz,oferta,1", "Acme", 0.8, "Opis")
    xml = "<urlset xmlns='x'><url><loc> https://theprotocol.it/praca/a,oferta,1 </loc></url><url><loc>https://theprotocol.it/b</loc></url></urlset>"
    maps = spark.createDataFrame([("theprotocol", xml), ("theprotocol", "<sitemapindex><loc>https://m.example</loc></sitemapindex>"), ("theprotocol", "<x"), ("theprotocol", None)], "source string, body string")
    assert sorted((r.kind, r.url) for r in pages.sitemap_links(maps).collect()) == [("sitemapindex", "https://m.example"), ("urlset", "https://theprotocol.it/praca/a,oferta,1")]
    links = spark.createDataFrame([("s", f"u{i % 5}", i % 3, i) for i in range(20)], "site string, url string, priority int, seq int")
    assert [r.url for r in pages.crawl_frontier(links, 2).orderBy("rank").collect()] == ["u0", "u3"]


def test_json_feeds(spark):
    bodies = [
        ("adzuna", json.dumps({"results": [{"id": 1, "title": " T ", "redirect_url": "u", "company": {"display_name": "C"}, "location": {"display_name": "L"}, "created": "d"}, {"id": 2, "title": "x"}]})),
        ("jooble", json.dumps({"jobs": [{"id": 5, "title": "T", "link": "u", "company": "C", "updated": "d"}]})), ("careerjet", json.dumps({"type": "JOBS", "jobs": [{"url": "u", "title": "T", "company": "C"}]})),
        ("careerjet", json.dumps({"type": "ERROR", "jobs": [{"url": "u", "title": "T", "company": "C"}]})), ("adzuna", "broken"), ("adzuna", None), ("adzuna", "{}"),
    ]
    df = spark.createDataFrame(bodies, "source string, body string")
    (a,) = json_feeds.feed_postings(df, json_feeds.FEEDS["adzuna"]).collect()
    assert (a.source_id, a.title, a.city, a.published_at, a.company_name_confidence) == ("1", "T", "L", "d", 0.97)
    assert [r.refreshed_at for r in json_feeds.feed_postings(df, json_feeds.FEEDS["jooble"]).collect()] == ["d"]
    assert [len(r.source_id) for r in json_feeds.feed_postings(df, json_feeds.FEEDS["careerjet"]).collect()] == [24]


def test_official_feed(spark):
    offer = {"identyfikatorOferty": "1", "stanowisko": "Kucharz", "pracodawca": "Acme", "link": "u", "nip": "123", "adresWww": "acme.example", "adresyMiejscPracy": [{}, {"miejscowosc": "Łódź"}]}
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.json", json.dumps({"data": {"oferty": [offer, {"stanowisko": "x"}]}}))
        z.writestr("b.txt", "x")
    soap = f"<e><s>OK</s><b>{base64.b64encode(held.getvalue()).decode()}</b></e>".encode()
    df = spark.createDataFrame([(soap,), (held.getvalue(),), (b"<e/>",), (b"<broken",), (None,)], "body binary")
    got = json_feeds.official_postings(df).collect()
    assert len(got) == 2 and (got[0].city, got[0].company_identifiers[0].value, got[0].company_website_candidates[0].url) == ("Łódź", "123", "acme.example")


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿url,title,company_name,city\nu1, T ,C,"Łódź, PL"\n,T,C,\nu3,"a\nb",C,\n', encoding="utf-8")
    got = files.read_postings_csv(spark, str(p)).collect()
    assert [(r.source_id, r.title, r.city, r.company_name_confidence) for r in got] == [("row-1", "T", "Łódź, PL", 1.0), ("row-3", "a\nb", None, 1.0)]
    p.write_text("url,title\nu,t\n")
    try:
        files.read_postings_csv(spark, str(p))
        raise AssertionError
    except ValueError as e:
        assert "company_name" in str(e)
