"""Problem 4: template residue, filler, error pages and script notices instead of content.

Every rule is a native column expression over the whole text, of any length:

* host evidence: the text speaks of nothing real, shares no term with its title and the last part of its address (for evidence texts, with the
  address and the signal it is evidence of), and its masked form (numbers and codes aside) stands under `LEAST_CONTEXTS`
  different titles or firms of `LEAST_HOSTS` hosts, at least one of them a posting: a page that was served in place of the
  records. Both tables give this evidence together, and it holds for the records of both;
* placeholders of template languages, outside sentences that speak of templates;
* responses: texts that open with a message of a server, a gate, a crashed program or a script notice, in the languages of the
  corpus, whose rest names too few terms of the title and holds no real content;
* filler: running text without any address, with next to no function word of any of the languages, made of few
  words over and over, that shares too few terms with title or address.

Host evidence is an aggregate over the masked forms of mismatched texts; form, host and title are
hashed and pre-aggregated before the shuffle, and the forms found join back on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.session import cut

#: Different titles or firms, and hosts, that one masked form must stand under to count as served in their place.
LEAST_CONTEXTS, LEAST_HOSTS = 3, 2
#: Share of the terms of title and address that a text about them names.
TERM_SHARE = 0.5
#: Letters of two words of one stem.
STEM = 5
#: Most function words among all words of filler, and the fewest words that can be told to be filler by that.
FUNCTION_SHARE, FILLER_WORDS = 0.02, 8
#: Different words among all words of filler, at most: it is made of a small stock.
FILLER_KINDS = 0.9

# Placeholder notations of template languages.
PLACEHOLDERS = (
    r"\{\{[^{}]{1,80}\}?\}", r"\$\{[^{}]{1,60}\}", r"\{%[^%]{1,80}%\}", r"<%=?[^%]{1,80}%>", r"@@\w{2,40}@@", r"#[A-Z][A-Z_]{2,40}#", r"%[A-Z][A-Z_]{2,40}%",
    r"__[A-Z][A-Z_]{2,40}__", r"<<\s*\w{2,40}\s*>>", r"(?<![\w$#{])\{[a-z][a-z_]{2,40}\}(?!\})", r"\[(?:wpisz|wstaw|uzupełnij|insert|enter|your|twoj[ae]?|bitte)\b[^\]]{0,60}\]",
    r"\[(?!PILN|NOW|NEW|HOT|URGENT|REMOTE|ZDALN|IT\]|HR\]|B2B)[A-Z][A-Z_]{2,25}(?: [A-Z_]{2,25}){0,3}\]",
)
# Stems of words in sentences that speak of templates.
TALK = r"(?:szablon|składni|zapis(?:ie|em|u)?\b|syntax|template|placeholder|schreibweise|vorlage|шаблон|синтаксис)"

# How responses open, by kind.
RESPONSES = {
    "status": (
        r"(?:error|http|błąd|fehler|помилка|status)[\s:/.\d-]*\b[45]\d\d\b", r"[45]\d\d[\s:–-]+(?:bad|forbidden|not|gone|internal|service|gateway|too|un\w+|request|server|conflict|method)\b",
        r"(?:ups|oops|hoppla|ой)\s*[!.]", r"[\p{L}\s]{3,60}\([45]\d\d\)",
    ),
    "missing": (
        r"(?:ta|ten|żądana|podana)\s+(?:strona|podstrona|ogłoszenie|oferta)\s+nie\s+(?:istnieje|została|jest)", r"(?:nie znaleziono|strony nie znaleziono)\s+(?:strony|zasobu|oferty|ogłoszenia)", r"(?:strony|zasobu|oferty) nie znaleziono",
        r"ogłoszenie,? którego szukasz", r"(?:the|this) (?:page|resource|site|advert|job)(?: you\s+\w+)?(?: \w+)? (?:could not|cannot|can't|was not|does not|is not|no longer|has been (?:removed|moved))",
        r"page not found", r"diese seite (?:wurde|konnte|existiert|ist) nicht", r"сторінк\w+ не (?:знайдено|існує)", r"цю сторінку не знайдено", r"zasób usunięto", r"brak dostępu do zasobu",
    ),
    "outage": (
        r"(?:trwa )?przerwa techniczna", r"trwają prace (?:techniczne|serwisowe)", r"coś poszło nie tak", r"something went wrong", r"(?:usługa|strona|serwis) (?:jest )?(?:chwilowo|tymczasowo) niedostępn",
        r"wewnętrzny błąd", r"zła brama", r"zbyt wiele zapytań", r"przekroczono czas", r"(?:we are )?(?:currently )?(?:down for|under) maintenance", r"service (?:temporarily )?unavailable", r"wartungsarbeiten", r"технічні роботи",
    ),
    "gate": (
        r"(?:access|dostęp|zugriff)\s+(?:denied|zablokowan|zabronion|verweigert)", r"verifying (?:that )?you are", r"sprawdzamy,? czy", r"checking (?:your browser|if the site)", r"(?:please )?(?:verify|confirm) (?:that )?you are (?:a )?human",
        r"potwierdź,? że (?:nie )?jesteś", r"sesja wygasła", r"(?:your )?session (?:has )?expired", r"ihre sitzung", r"zaloguj się,? aby", r"доступ заборонено", r"перевіряємо",
    ),
    "scripts": (
        r"(?:java\s?script|obsługa skryptów|skrypty|scripts?) (?:jest|są|is|are|ist|must|muss|wymaga)\s*(?:wyłączon|wymagan|disabled|required|deaktiviert|be enabled|erforderlich|aktiviert)", r"do (?:poprawnego )?działania (?:serwisu|strony|aplikacji) wymagan", r"włącz (?:obsługę )?(?:java|skrypt)",
        r"(?:please )?(?:turn on|enable|activate) (?:java\s?script|scripts|scripting)", r"you need to enable", r"bitte aktivieren sie (?:java|skript)", r"увімкніть (?:java|скрипт)", r"ta (?:aplikacja|strona) (?:nie uruchomi się|nie działa|wymaga|nie zadziała)[^.]{0,20}skrypt",
        r"your browser (?:does not|doesn't) (?:run|support)", r"(?:twoja )?przeglądarka nie (?:obsługuje|uruchamia)", r"this (?:site|page|app\w*) (?:requires|needs) (?:java|script)", r"<noscript",
    ),
    "broken": (
        r"traceback\b", r"null\s?reference", r"sqlstate", r"(?:warning|notice|fatal error|uncaught|deprecated)\s*:", r"exception in thread", r"\w+(?:error|exception)\s*(?::|at\b)", r"\[object object\]", r"(?:(?:null|nan|undefined|none|nil|n/a|true|false)[\s,;.]*)+$",
        r"<!--[^>]*-->\s*$", r"\{\s*\"(?:error|status|message|code)\"", r"<\?(?:php|xml)", r"(?:loading|ładowanie(?: treści)?|wczytywanie|trwa ładowanie|lädt|завантаження)\s*(?:…|\.{2,}|$)", r"please wait\b",
    ),
    "filler": (
        r"lorem\b", r"todo\b", r"fixme\b", r"tutaj wpisz", r"wprowadź (?:tekst|treść|opis)", r"wpisz (?:tekst|treść|opis)", r"treść ogłoszenia \(?do uzupełnienia", r"(?:opis|treść)?\s*\(?do uzupełnienia", r"tekst (?:przykładowy|zastępczy)",
        r"(?:sample|dummy|example|placeholder) text", r"(?:beispiel|platzhalter|muster)text", r"(?:insert|enter|your) (?:text|description) here", r"зразок тексту", r"текст[- ]заповнювач", r"приклад тексту",
        r"(\p{L}{2,12})(?:[\s,.]+\1){2,}(?:[\s\d.,]|\([\p{L}]+\))*$", r"test(?:[\s\d.,]+(?:test)?)*(?:\(\p{L}+\))?$", r"(?:asdf|qwer|xxx)\w*",
    ),
}

# Common function words of the corpus's languages (Polish, English, German, Ukrainian).
FUNCTION_WORDS = (
    "i w z na do się nie o za od po dla jest to że oraz lub przez przy jak co ze są a u pod nad bez"
    " the of and to in for with is are on you your we or as by our at from be will this an"
    " der die das und für mit sie wir ist im auf den dem ein eine zu von bei als oder nach zum zur am"
    " та і в у на з для до що як або за ми не про від під є й по над"
).split()

# Stems of what adverts and firms say of work; a text with `CONTENT_STEMS` of them is real content.
CONTENT = (
    "zapewniamy oferujemy wymagamy szukamy kandydat stanowisk zespo załog pracown umow wynagrodz premi doświadcz zatrudn zmianow kwalifik szkoleni nadgodzin orzeczeni wdrożeni atut"
    " candidate salary team experience shift benefit employ requirement training overtime bewerb gehalt erfahrung mitarbeit schicht schulung überstunden"
    " кандидат зарплат досвід команд працівник навчання вимог"
).split()
CONTENT_STEMS = 3


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, as an array; empty for NULL."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def has_placeholder(text: Column) -> Column:
    """Whether a placeholder stands outside the sentences that speak of templates."""
    spoken = F.regexp_replace(text, r"(?iU)[^.!?\n]{0,400}?" + TALK + r"[^.!?\n]{0,400}[.!?]?", " ")
    hint = text.rlike(r"[{$]\{|\{[%a-z]|<[%<]|@@|[#%][A-Z]|__[A-Z]|\[\p{L}")  # what each of them begins with
    some = F.lit(False)
    for sign in ("{", "<", "@@", "#", "%", "__", "["):
        some |= text.contains(sign)
    return F.when(some & hint, F.when(text.rlike("(?iU)" + TALK), spoken).otherwise(text).rlike("|".join(PLACEHOLDERS))).otherwise(False)


def stems(ws: Column) -> Column:
    """The first letters of each different word of more than three letters."""
    return F.array_distinct(F.transform(F.filter(ws, lambda w: F.length(w) > 3), lambda w: F.substring(w, 1, STEM)))


def terms_named(lower: Column, terms: Column) -> Column:
    """How many of the stems `terms` stand in a text in lower case."""
    # the text goes with the sum: within a filter's function it would be put in lower case for each stem
    first = F.struct(lower.alias("text"), F.lit(0).alias("n"))
    return F.aggregate(terms, first, lambda s, t: F.struct(s["text"].alias("text"), (s["n"] + F.contains(s["text"], t).cast("int")).alias("n")), lambda s: s["n"])


def is_real(lower: Column) -> Column:
    """Whether a text in lower case speaks of work in `CONTENT_STEMS` ways."""
    held = [F.contains(lower, F.lit(x)).cast("int") for x in CONTENT]
    return sum(held[1:], held[0]) >= CONTENT_STEMS


def is_response(text: Column, lower: Column, terms: Column) -> Column:
    """Whether a text opens like a response and its rest neither names the stems `terms` nor is real content."""
    opening = "|".join(p.replace(r"\1", rf"\{n}") for p, n in zip([p for ps in RESPONSES.values() for p in ps], _backreferences()))
    opening = r"(?iU)^[\s\p{Z}\"„'*#>-]*(?:" + opening + ")"
    return F.when(~text.rlike(opening), False).when(is_real(lower), False).otherwise(terms_named(F.lower(F.regexp_replace(text, opening, " ")), terms) <= F.size(terms) * TERM_SHARE)


def _backreferences() -> list[int]:
    """The number of the capturing group each pattern would open in the joined expression."""
    out, n = [], 0
    for p in (p for ps in RESPONSES.values() for p in ps):
        opened = sum(1 for i, c in enumerate(p) if c == "(" and p[i + 1] != "?" and (i == 0 or p[i - 1] != "\\"))
        out.append(n + 1)
        n += opened
    return out


def is_filler(w: Column, named: Column, terms: Column) -> Column:
    """Running words `w` with next to no function word, that repeat themselves and name too few of the stems `terms`."""
    lists = F.array(*[F.lit(x) for x in FUNCTION_WORDS])
    n, kinds = F.size(w), F.size(F.array_distinct(w))
    functions = F.size(F.filter(w, lambda x: F.array_contains(lists, x)))
    few = F.size(F.array_intersect(w, lists)) <= n * FUNCTION_SHARE  # different ones are no more than all
    return F.when((n >= FILLER_WORDS) & (kinds < n * FILLER_KINDS) & few, (functions <= n * FUNCTION_SHARE) & (named <= F.size(terms) * TERM_SHARE)).otherwise(False)


def masked_form(w: Column) -> Column:
    """A hash of the words `w` in order without those that hold digits, as numbers and codes do."""
    return F.xxhash64(F.filter(w, lambda x: ~x.rlike("[0-9]")))


def _read(records: DataFrame, table: str, id_col: str, text_col: str, url_col: str, title_col: str | None, signal_col: str | None, firm_col: str | None) -> DataFrame:
    """record_table, record_id, the flags of the detectors and what host evidence needs, of every non-blank text."""
    text, url = F.col(text_col), F.coalesce(F.col(url_col), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://[^/?#]*", ""), r"[?#].*$|/+$", "")
    t = records.filter(text.rlike(r"[^\s\p{Z}\x{feff}]")).select(
        F.lit(table).alias("record_table"), F.col(id_col).cast("bigint").alias("record_id"), text.alias("_text"), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)).alias("_host"),
        F.lower(blank(title_col)).alias("_title"), F.concat_ws(" ", F.lower(blank(title_col)), F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*", " "), F.lower(blank(signal_col))).alias("_about"), blank(firm_col).alias("_firm"),
    )
    # each of these is used more than once, so the optimizer leaves it where it is
    t = t.withColumns({"_w": words(F.col("_text")), "_low": F.lower("_text"), "_terms": stems(words(F.col("_about")))})
    t = t.withColumn("_named", terms_named(F.col("_low"), F.col("_terms")))
    context = F.when(F.lit(title_col is not None), F.col("_title")).otherwise(F.col("_firm"))
    t = t.withColumns({"placeholder": has_placeholder(F.col("_text")), "response": is_response(F.col("_text"), F.col("_low"), F.col("_terms")), "filler": F.when(is_filler(F.col("_w"), F.col("_named"), F.col("_terms")), ~F.col("_text").rlike(r"[^\s(\[][@:/.][\p{L}\p{N}]")).otherwise(False)})
    strange = (F.size("_terms") > 0) & (F.col("_named") == 0) & (F.col("_host") != "") & (context != "")
    t = t.withColumn("_form", F.when(strange, F.when(~is_real(F.col("_low")), masked_form(F.col("_w")))))
    row = F.struct("record_table", "record_id", "placeholder", "response", "filler", "_form", F.xxhash64("_host").alias("_h"), F.xxhash64(context).alias("_c"), F.lit(title_col is not None).alias("_titled"))
    return t.select(F.inline(F.array(row)))  # a filter on what is generated isn't pushed below it, where all would be evaluated twice


def residue_evidence(postings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """record_table, record_id, placeholder, response, filler, served of every non-blank text of both tables that has any evidence.

    NULL and blank texts never count; NULL titles, addresses, signals and firms give no terms and no host evidence;
    texts of any length are read whole; repeated rows are kept; other columns are ignored; empty tables give no rows.
    """
    t = _read(postings, "job_postings", "id", "description", "url", "title", None, None).unionByName(
        _read(snapshots, "contact_evidence_snapshots", "id", "evidence_text", "evidence_url", None, "evidence_signal", "company_id")
    )
    t = cut(t.filter("placeholder or response or filler or _form is not null"))
    forms = t.filter(F.col("_form") != masked_form(F.array().cast("array<string>"))).groupBy("_form", "_h", "_c").agg(F.max("_titled").alias("_titled"))
    served = forms.groupBy("_form").agg(F.approx_count_distinct("_c", 0.02).alias("_contexts"), F.approx_count_distinct("_h", 0.02).alias("_hosts"), F.max("_titled").alias("_titled"))
    served = served.filter((F.col("_contexts") >= LEAST_CONTEXTS) & (F.col("_hosts") >= LEAST_HOSTS) & F.col("_titled")).select("_form", F.lit(True).alias("_served"))
    found = t.join(served, "_form", "left").withColumn("served", F.coalesce("_served", F.lit(False)))
    return found.filter("placeholder or response or filler or served").select("record_table", "record_id", "placeholder", "response", "filler", "served")


def found_residue(postings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """record_table, record_id of residue among job postings and contact evidence (cases: see `residue_evidence`)."""
    return residue_evidence(postings, snapshots).select("record_table", "record_id")
