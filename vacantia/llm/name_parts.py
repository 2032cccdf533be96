"""Reading a typed name of a firm into its distinctive core and the words that qualify it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from vacantia.llm.places import _shorter, fold, within

# Trades as written in Polish and English, by code.
TRADES = {
    "transport": ("transport services", "transport"), "real_estate": ("nieruchomosci", "real estate"), "security": ("ochrona", "security"), "legal": ("doradztwo prawne", "legal advisory"), "finance": ("finanse", "finance"),
    "hotels": ("hotele", "hotels"), "catering": ("gastronomia", "catering", "gastro"), "bakeries": ("piekarnie", "bakeries"), "training": ("szkolenia", "training"), "construction": ("budownictwo", "construction"),
    "steel": ("konstrukcje stalowe", "steel structures"), "print": ("druk cyfrowy", "digital print"), "automation": ("automatyka przemyslowa", "industrial automation"), "packaging": ("opakowania", "packaging"),
    "heating": ("systemy grzewcze", "heating systems"), "furniture": ("meble", "furniture"), "education": ("edukacja", "education"), "sport": ("klub sportowy", "sports club", "ks"), "electrical": ("instalacje elektryczne", "electrical installations"),
    "software": ("oprogramowanie", "software"), "gardening": ("ogrodnictwo", "gardening"), "medical": ("uslugi medyczne", "medical services"), "laboratories": ("laboratoria", "laboratories"), "logistics": ("logistyka", "logistics"), "staffing": ("personel", "personnel", "staffing"),
}
# Kinds of business that precede a name, with their initials.
FORMS = {
    "pph": ("przedsiebiorstwo produkcyjno handlowe", "pph", "p p h"), "phu": ("przedsiebiorstwo handlowo uslugowe", "phu", "p h u"), "ppu": ("przedsiebiorstwo produkcyjno uslugowe", "ppu", "p p u"), "fh": ("firma handlowa", "fh", "f h"),
    "zu": ("zaklad uslugowy", "zu", "z u"), "ur": ("uslugi remontowe", "ur", "u r"), "gf": ("gabinet fizjoterapii", "gf", "g f"), "bp": ("biuro projektowe", "bp", "b p"), "spn": ("spoldzielnia pracy", "sp nia pracy"),
}
# Legal forms and words that belong to no name.
LEGAL = (
    "spolka z ograniczona odpowiedzialnoscia", "spolka z o o", "sp z o o", "sp z oo", "spolka komandytowo akcyjna", "spolka komandytowa", "sp k", "spk", "spolka jawna", "sp j", "spj", "spolka akcyjna", "s a", "sa", "spolka cywilna", "s c", "sc",
    "spolka", "sp", "ltd", "gmbh", "llc", "inc",
)
NOISE = frozenset("polska poland grupa group oddzial branch hr kadr kadry rekrutacja www http https pl com eu net org example i and firma przedsiebiorstwo".split())
# First names with their familiar forms.
FIRST = {
    "zbigniew": "zbyszek", "zofia": "zosia", "stanislaw": "staszek stas", "magdalena": "magda", "slawomir": "slawek", "agnieszka": "aga", "wojciech": "wojtek", "tomasz": "tomek", "aleksandra": "ola", "malgorzata": "gosia malgosia",
    "grzegorz": "grzesiek grzes", "krzysztof": "krzysiek krzys", "wladyslaw": "wladek", "barbara": "basia", "elzbieta": "ela", "jan": "janek jas", "katarzyna": "kasia", "joanna": "asia", "piotr": "piotrek", "andrzej": "andrzejek jedrek",
    "anna": "ania", "maria": "marysia", "ewa": "ewka", "marek": "mareczek", "pawel": "pawelek", "michal": "michalek", "jerzy": "jurek", "jozef": "jozek", "tadeusz": "tadek", "ryszard": "rysiek", "kazimierz": "kazik", "jakub": "kuba", "monika": "",
    "teresa": "terenia", "danuta": "danka", "halina": "halinka", "irena": "irenka", "robert": "", "mariusz": "", "dariusz": "darek", "adam": "", "lukasz": "", "beata": "", "dorota": "", "marta": "", "helena": "", "janusz": "",
}


def _phrases() -> dict[tuple[str, ...], tuple[str, str]]:
    out = {}
    for kind, table in (("trade", TRADES), ("form", FORMS)):
        for code, ways in table.items():
            for way in ways:
                out[tuple(way.split())] = (kind, code)
    for way in LEGAL:
        out[tuple(way.split())] = ("legal", way)
    for way in ("biuro kadr", "dzial kadr", "biuro rekrutacji"):
        out[tuple(way.split())] = ("legal", way)
    return out


PHRASES = _phrases()
#: Words that start phrases, with the length of the longest.
STARTS = {p[0]: max(len(q) for q in PHRASES if q[0] == p[0]) for p in PHRASES}
NICKNAMES = {short: full for full, shorts in FIRST.items() for short in [full, *shorts.split()]}
#: Words that a misspelt or abbreviated word may stand for.
QUALIFIERS = sorted({w for p, (kind, _) in PHRASES.items() if kind != "legal" for w in p if len(w) > 4})
BY_START: dict[str, list[str]] = {}
for _w in QUALIFIERS:
    for _n in (2, 3):
        BY_START.setdefault(_w[:_n], []).append(_w)


NEAR: dict[str, set[str]] = {}
for _w in QUALIFIERS:
    for _n in _shorter(_w, 1):
        NEAR.setdefault(_n, set()).add(_w)


@dataclass(frozen=True)
class Name:
    """core: letters that tell the firm apart; person: its first name (full or an initial), or ''.

    sorted_core: the words of a core of several in the order of the alphabet; acronym: the initials of three or more.
    """

    core: str
    trades: tuple[str, ...]
    forms: tuple[str, ...]
    person: str
    sorted_core: str = field(default="", compare=False)
    acronym: str = field(default="", compare=False)


def _whole(word: str, dotted: bool) -> str | None:
    """The qualifying word that an abbreviated (dotted) or misspelt word stands for."""
    if dotted and len(word) >= 2:
        fits = [q for q in BY_START.get(word[:3] if len(word) > 2 else word, ()) if q.startswith(word) and q != word]
        if fits:
            return fits[0] if len(fits) == 1 else "|".join(fits)
    if len(word) > 5:
        fits = {q for short in _shorter(word, 1) for q in NEAR.get(short, ()) if within(word, q, 1) is not None}
        if fits:
            return min(fits)
    return None


@lru_cache(maxsize=200_000)
def _read_word(word: str, dotted: bool) -> tuple[tuple[str, str | None], ...]:
    """The folded words of a token, each with what it may stand for."""
    return tuple((w, None if (w,) in PHRASES or w in NICKNAMES else _whole(w, dotted)) for w in fold(word).split())


_TOKEN = re.compile(r"([^\W_]+)(\.?)")
_HOST = re.compile(r"(?:https?://)?[\w-]+(?:\.[\w-]+)+/?")
_ZERO, _ONE = re.compile(r"[^\W\d_]0|0[^\W\d_]"), re.compile(r"(?<=[^\W\d_])1(?=[^\W\d_])")


def read_name(raw: str, city_words: frozenset[str] = frozenset()) -> Name:
    """The parts of a typed name; `city_words` (folded) are the words of the firm's own city."""
    text = raw.replace("0", "o") if "0" in raw and _ZERO.search(raw) else raw
    text = _ONE.sub("l", text) if "1" in text else text
    is_host = bool(_HOST.fullmatch(text.strip()))
    words: list[str] = []
    sources: dict[str, str] = {}
    for word, dot in _TOKEN.findall(text):
        for w, options in _read_word(word, dot == "."):
            if options and not is_host:
                sources[w] = options
            words.append(w)

    def ways(w: str) -> list[str]:
        return [w, *sources[w].split("|")] if w in sources else [w]

    trades, forms, left = set(), set(), []
    i = 0
    while i < len(words):
        longest = max(STARTS.get(o, 0) for o in ways(words[i]))
        for n in range(min(longest, len(words) - i), 0, -1):
            if n == 1 and len(words) == 1:
                continue
            window = [ways(w) for w in words[i : i + n]]
            hit = _match(window)
            if hit:
                kind, code = hit
                (trades if kind == "trade" else forms if kind == "form" else set()).add(code)
                i += n
                break
        else:
            left.append(words[i])
            i += 1
    person, core, initials = "", [], []
    for w in left:
        if w in NICKNAMES and not person:
            person = NICKNAMES[w]
        elif len(w) == 1:
            initials.append(w)
        elif w in NOISE or w in city_words or w.isdigit():
            continue
        elif w in sources and len(left) > 1 and "|" not in sources[w] and _single(sources[w]):
            (trades if PHRASES[(sources[w],)][0] == "trade" else forms).add(PHRASES[(sources[w],)][1])
        else:
            core.append(w)
    if not person and initials and len(initials) == 1:
        person = initials[0]
    if is_host and core:
        core = core[:1] if len(core) > 1 and any((w,) in PHRASES for w in core[1:]) else core
    return Name("".join(core), tuple(sorted(trades)), tuple(sorted(forms)), person, "".join(sorted(core)), "".join(w[0] for w in core) if len(core) > 2 else "")


def _single(word: str) -> bool:
    return (word,) in PHRASES


def _match(window: list[list[str]]) -> tuple[str, str] | None:
    combos = [()]
    for options in window:
        combos = [c + (o,) for c in combos for o in options if o]
        if len(combos) > 64:
            return None
    return next((PHRASES[c] for c in combos if c in PHRASES), None)
