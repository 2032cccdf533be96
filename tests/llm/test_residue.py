"""Residue detectors on worked texts of every kind, traps, and odd tables."""

from vacantia.llm import residue

FOUND = [
    "Praca {% if miasto %} w firmie {{ nazwa_firmy }} od zaraz.", "Oferta dla {stanowisko} w oddziale", "Kontakt: #TELEFON# w godzinach", "Zarobki %SALARY% brutto", "Pisz do [CONTACT EMAIL] dziś", "Zespół [wpisz: nazwa firmy] rośnie",
    "Miasto __MIASTO__ i @@data@@", "<%= employer %> szuka", "Dla <<stanowisko>> mamy", "Stawka ${salary} za godzinę", "403 Forbidden", "HTTP 503 - Service Unavailable", "Error 502: Zła brama.", "Zasób usunięto (410). Wróć na stronę główną.",
    "Ups! Brak dostępu do zasobu. Kod błędu: 403, ślad 9d", "Diese Seite wurde nicht gefunden.", "The page you requested could not be loaded. Try refreshing.", "Trwa przerwa techniczna. Wracamy o 9:30.", "Access denied. Incident 9cdc4a9",
    "Verifying that you are a human visitor... ray 9a", "Sesja wygasła, zaloguj się ponownie, aby zobaczyć treść.", "Do poprawnego działania serwisu wymagany jest JavaScript. <noscript>", "Ta aplikacja nie uruchomi się bez skryptów. ",
    "Увімкніть JavaScript, щоб переглянути сторінку.", "Bitte aktivieren Sie JavaScript, um fortzufahren. Kod: 9", "Your browser does not run scripts; this application cannot start.", "Traceback: ValueError at line 9 in render_offer",
    "NullReference at Offer.Render() row 627", "SQLSTATE[00200]: connection refused", "[object Object]", "null null null", "NaN", "undefined", "<!-- content -->", '{"error":"not authorised","status":403}', "Loading...", "Ładowanie treści…",
    "TODO: uzupełnić treść (maveris)", "Tutaj wpisz opis stanowiska", "Sample text, replace before publishing 4", "asdf asdf asdf.", "xxx xxx xxx", "test test 9 9", "opis opis opis opis (laboris)", "Beispieltext, bitte ersetzen",
    "Elitra magnor elitra fugitam tempro ampera pelluca quorem tristique elitra magnor elitra quorem.",
]
REAL = [
    "Pracujemy na szablonach, w których zapis {{ zmienna }} zamienia się na dane klienta; umiesz je czytać?", "Składnia ${zmienna} w powłoce nie powinna Cię zaskoczyć.", "Uzupełniamy [pilnie] skład brygady, liczba miejsc: 5.",
    "Do zadań należy obsługa zgłoszeń typu Error 503 od użytkowników.", "Wymagana znajomość JavaScript oraz TypeScript, a także obsługi stron błędów 404 i 500.", "You will debug JavaScript bundles and write friendly not-found pages.",
    "Strona kariery wymaga skryptów tylko przy wysyłce CV, można też przynieść je osobiście.", "Premia do 10% brutto, a w sezonie nawet 15%.", "Linia produkcyjna nr 404 szuka operatora, hala 502.", "Numer [00282] wpisz w tytule.",
    "Usuwamy usterki, zanim klient zobaczy komunikat o niedostępnej stronie.", "Kontakt handlowy: a_b@firma.example, telefon wewnętrzny 4.",
]
SCHEMA = "id bigint, description string, url string, title string, record_id string, evidence_text string, evidence_url string, evidence_signal string, company_id bigint"


def frame(spark, texts, signal=None):
    rows = [(i, t, f"https://host{i % 5}.example/oferta/{i}", f"Stanowisko{i} pracownik", "clash", t, f"https://site{i}.example/o-firmie", signal, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df, snapshots=False):
    out = residue.found_residue(df.limit(0), df) if snapshots else residue.found_residue(df, df.limit(0))
    return sorted(r.record_id for r in out.collect())


def test_kinds_and_traps(spark):
    for snapshots in (False, True):
        assert found(frame(spark, FOUND), snapshots) == list(range(len(FOUND)))
        assert found(frame(spark, REAL), snapshots) == []


def test_residue_in_long_texts(spark):
    real = "Zapewniamy odzież i posiłek, a w sezonie premię. " * 3000
    assert found(frame(spark, [real, real + " Zapraszamy do {{ nazwa_firmy }}.", real + REAL[0], REAL[0] + " Oferta {{ opis }} czeka."])) == [1, 3]


def test_long_responses_and_filler(spark):
    menu = "Menu: oferty, firmy, kontakt, regulamin, polityka prywatności. " * 12
    lorem = FOUND[-1] + " " + "Elitra magnor fugitam tempro ampera pelluca quorem tristique. " * 20
    trace = "Traceback (most recent call last): " + "File offer.py line 9 in render value missing. " * 15
    real = "Ups! To nie pomyłka, szukamy ludzi do hali. " + "Zapewniamy odzież i posiłek, a w sezonie premię. " * 12
    check = "Sprawdzamy, czy kandydat bezpiecznie łączy się z siecią zakładu. Zapewniamy odzież i posiłek. " + "Nadgodziny są płatne, a szkolenie trwa dwa dni. " * 6
    assert found(frame(spark, [check])) == []
    page = "404 Not Found. " + "Wybierz inny adres z listy albo wpisz go jeszcze raz w pasku u góry okna. " * 5
    latin = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. " * 9
    nonsense = ("Elitra magnor fugitam tempro ampera pelluca quorem tristique do " * 30 + "vastura ").strip()
    assert found(frame(spark, [page, latin, nonsense])) == [0, 1]  # a tenth of function words is no filler
    assert found(frame(spark, ["Access denied. Incident 9cdc4a9. " + menu, lorem, trace, real])) == [0, 1, 2]


def test_pages_served_under_many_titles(spark):
    same = ["Odczekaj chwilę, wracamy niebawem, kod 4a7" for _ in range(20)]
    assert found(frame(spark, same)) == list(range(20))
    assert found(frame(spark, same[:2])) == []
    long = ["Odczekaj chwilę, wracamy niebawem. " * 40 + f"Kod {i}a7" for i in range(20)]
    assert found(frame(spark, long)) == list(range(20))
    own = frame(spark, same).selectExpr("*").drop("description", "title").selectExpr("*", "'Opis: stanowisko kucharz, zmiana nocna' as description", "concat('Kucharz ', id) as title")
    assert found(own) == []


def test_evidence_of_both_tables_together(spark):
    """A page that stands for a posting and under two firms is served; forms of contact pages alone are no evidence."""
    text, form = "Odczekaj chwilę, wracamy niebawem, kod 4a7", "Formularz zapytania: nazwa firmy, zakres, temat"
    got = {(r.record_table, r.record_id, r.served) for r in residue.residue_evidence(frame(spark, [text, "Opis pracy stanowisko0"]), frame(spark, [text, text, form, form, form, form])).collect()}
    assert got == {("job_postings", 0, True), ("contact_evidence_snapshots", 0, True), ("contact_evidence_snapshots", 1, True)}
    told = frame(spark, [text, text], signal="chwilowy kontakt")
    assert {r.record_table for r in residue.residue_evidence(frame(spark, [text]), told).collect()} == set()


def test_nulls_blanks_and_empty_tables(spark):
    rows = [(i, t, None, None, "x", t, None, None, None) for i, t in ((1, None), (2, " \n\t "), (3, "NaN"), (3, "NaN"))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == [3, 3] and found(df.limit(0)) == []


def test_both_tables(spark):
    out = residue.found_residue(frame(spark, FOUND[:1]), frame(spark, FOUND[:2]))
    assert sorted(map(tuple, out.collect())) == [("contact_evidence_snapshots", 0), ("contact_evidence_snapshots", 1), ("job_postings", 0)]
