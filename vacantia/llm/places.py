"""Problem 5: mapping freely typed values to the entries of a reference list.

1. An automaton over the normalised canonical names and their aliases (inflected forms) finds the
   mentions embedded in a value in one pass; mentions are whole words, the longest
   non-overlapping ones win.
2. Parts of the value without a mention go to token-set similarity: their tokens, less those that
   never name a place, against the token sets of the names, in any order. A name is found when each of its tokens
   agrees with a token of its own; tokens agree up to one edit (two in words of eight letters or more) or when the
   value's one is a case of the other's. Indexes of single deletions, of pairs of letters and of beginnings find the
   tokens to compare with; names typed in one word and words typed apart are compared joined.
3. Region names in the value decide between entries of the same name. A value that names no entry,
   or several, maps to 0.

The reference list is collected, checked against `MAX_ENTRIES` and sent with the function; values are
resolved in the scan's own tasks, each distinct value of an Arrow batch once. No row is shuffled, so
no value is too frequent.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache
from os.path import commonprefix

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most entries of a reference list that is sent to every task (about 1 KB each with its aliases).
MAX_ENTRIES = 200_000
#: Letters that begin a word and its cases alike, at least.
BEGINNING = 4

# Words of addresses and of job adverts that name no place.
NOISE = frozenset(
    "ul ulica al aleja os osiedle plac m miasto w we i oraz k kolo okolice okolica centrum pl polska poland zdalnie zdalna hybrydowo praca remote home office woj wojewodztwo powiat gmina gm"
    " stare srodmiescie przedmiescie polnoc poludnie wschod zachod dzielnica".split()
)
# Words that start a street.
STREET = frozenset("ul ulica al aleja os osiedle plac".split())
# Endings of Polish place names and those of their locative, without accents.
LOCATIVE = (
    ("ow", "owie"), ("borz", "borzu"), ("brzeg", "brzegu"), ("ice", "icach"), ("ica", "icy"), ("cin", "cinie"), ("in", "inie"), ("iec", "cu"), ("grod", "grodzie"),
    ("dol", "dole"), ("leka", "lece"), ("slaw", "slawiu"), ("mierz", "mierzu"), ("wice", "wicach"),
)
# Endings of the cases in which places are named, and the endings of names that they replace.
CASES = frozenset("u e y i a ie iu im ym em ej ach owie zie cie dzie rze ze ce le cu".split())
REPLACED = frozenset(("", *"a e i y o ia ie ka ca ce iec ec".split()))
ADJECTIVE = (("stary", "starym"), ("nowy", "nowym"), ("gorny", "gornym"), ("dolny", "dolnym"), ("wielki", "wielkim"), ("maly", "malym"))


def fold(text: str) -> str:
    """Lower case, without accents, every run of other characters than letters and digits a blank."""
    t = unicodedata.normalize("NFKD", text.casefold().replace("ł", "l"))
    return re.sub(r"[^0-9a-z]+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip()


def aliases(name: str) -> set[str]:
    """The folded name and its forms in the locative."""
    out, words = {name}, name.split()
    forms = []
    for w in words:
        own = {w + to[len(to) :] if w == end else w[: -len(end)] + to for end, to in LOCATIVE if w.endswith(end)} | {to for nom, to in ADJECTIVE if w == nom}
        forms.append(own or {w})
    if len(words) == 1:
        out |= forms[0]
    else:
        heads = [""]
        for f in forms:
            heads = [f"{h} {x}".strip() for h in heads for x in f]
        out |= set(heads)
    return out


def within(a: str, b: str, most: int) -> int | None:
    """Edits between a and b (insert, delete, replace, swap of neighbours), None above `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return None
        two, one = one, row
    return one[-1] if one[-1] <= most else None


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 2


def _pairs(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[i : i + 2] for i in range(len(marked) - 1)}


def _shorter(word: str, most: int) -> set[str]:
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Resolver:
    """Entries (id, name, region) of a reference list, ready to resolve values."""

    def __init__(self, entries: Iterable[tuple[int, str, str | None]]):
        self.by_name: dict[str, list[tuple[int, str]]] = {}
        for i, name, region in entries:
            if name and fold(name):
                self.by_name.setdefault(fold(name), []).append((i, fold(region or "")))
        self.regions = {r for es in self.by_name.values() for _, r in es if r}
        self.forms: dict[str, set[str]] = {}
        for name in self.by_name:
            for a in aliases(name):
                self.forms.setdefault(a, set()).add(name)
        self.spelt: dict[str, set[str]] = {}
        for form, names in self.forms.items():
            for name in names:
                self.spelt.setdefault(name, set()).add(form)
        self.automaton = ahocorasick.Automaton()
        for form in self.forms:
            self.automaton.add_word(f" {form} ", form)
        self.automaton.make_automaton() if self.forms else None
        # what a word of a value may stand for: a token of a name, or a form typed in one word
        self.tokens: dict[str, set[str]] = {}  # token to names
        self.joined: dict[str, set[str]] = {}  # joined form to names
        for form, names in self.forms.items():
            for w in form.split():
                self.tokens.setdefault(w, set()).update(names)
            self.joined.setdefault(form.replace(" ", ""), set()).update(names)
        self.near: dict[str, set[str]] = {}
        self.pairs: dict[str, list[str]] = {}
        self.starts: dict[str, list[str]] = {}
        for word in self.tokens.keys() | self.joined.keys():
            for s in _shorter(word, 1):
                self.near.setdefault(s, set()).add(word)
            if len(word) > 5:  # a word of eight letters and one of two fewer
                for g in _pairs(word):
                    self.pairs.setdefault(g, []).append(word)
            if len(word) > BEGINNING:
                self.starts.setdefault(word[:BEGINNING], []).append(word)
        self.alike = lru_cache(maxsize=200_000)(self._alike)
        self.resolve = lru_cache(maxsize=200_000)(self._resolve)

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """Longest non-overlapping (start, end, form) in folded text with a blank at either end."""
        if not self.forms:
            return []
        found = sorted(((end - len(form) - 1, end, form) for end, form in self.automaton.iter(text)), key=lambda m: (m[0] - m[1], m[0]))
        taken: list[tuple[int, int, str]] = []
        for m in found:
            if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                taken.append(m)
        return sorted(taken)

    def _alike(self, word: str) -> dict[str, int]:
        """The tokens and joined forms that a word agrees with, with the edits; a case counts as three."""
        most = edits_allowed(word)
        out = {word: 0} if word in self.tokens or word in self.joined else {}
        if most:
            found = {w for s in _shorter(word, 1) for w in self.near.get(s, ())}
            if most > 1:  # two edits leave all pairs of letters but six
                shared = Counter(w for g in _pairs(word) for w in self.pairs.get(g, ()))
                found |= {w for w, n in shared.items() if n >= len(_pairs(word)) - 6}
            for w in found:
                d = within(word, w, most)
                if d is not None:
                    out[w] = min(d, out.get(w, d))
        for w in self.starts.get(word[:BEGINNING], ()) if len(word) > BEGINNING else ():
            n = len(commonprefix((word, w)))
            if word[n:] in CASES and w[n:] in REPLACED:
                out.setdefault(w, 3)
        return out

    def similar(self, part: str, least_words: int = 1) -> set[str]:
        """Names all of whose tokens agree with tokens of a folded part that may name a place, in any order.

        The names that cover most words win, of these the ones with the fewest edits. `least_words`
        leaves out names that agree with fewer words.
        """
        words = [w for w in part.split() if not w.isdigit() and len(w) > 1 and w not in NOISE]
        if not words or words[0] in STREET:
            return set()
        best: dict[str, tuple[int, int]] = {}
        by_name: dict[str, dict[str, list[tuple[int, int]]]] = {}  # name, its token, (edits, place of the word)
        for i in range(len(words)):
            for j in range(i + 1, min(i + 3, len(words)) + 1):
                for w, d in self.alike("".join(words[i:j])).items():
                    if j == i + 1:
                        for name in self.tokens.get(w, ()):
                            by_name.setdefault(name, {}).setdefault(w, []).append((d, i))
                    for name in self.joined.get(w, ()):
                        best[name] = min((i - j, d), best.get(name, (0, 99)))
        for name, tokens in by_name.items():
            for form in self.spelt[name]:
                own = form.split()
                if len(own) > 1 and all(t in tokens for t in own):
                    edits, taken = 0, set()
                    for t in sorted(own, key=lambda t: len(tokens[t])):
                        free = [x for x in tokens[t] if x[1] not in taken]
                        if not free:
                            break
                        d, i = min(free)
                        taken.add(i)
                        edits += d
                    else:
                        best[name] = min((-len(own), edits), best.get(name, (0, 99)))
        best = {n: rank for n, rank in best.items() if -rank[0] >= least_words}
        first = min(best.values(), default=None)
        return {n for n, rank in best.items() if rank == first}

    def region_of(self, text: str) -> set[str]:
        return {r for r in self.regions if f" {r} " in text} or {
            r for w in text.split() if len(w) > 7 for r in self.regions if within(w, r, 1) is not None
        }

    def _resolve(self, value: str) -> int:
        parts = [f" {fold(p)} " for p in re.split(r"[,;/|()\[\]&+]|\s[-–—]\s|\s+(?:i|oraz|lub|albo)\s+|:", value)]
        parts = [p for p in parts if p.strip()]
        names: set[str] = set()
        left: list[str] = []
        for p in parts:
            if p.split()[0] in STREET:
                continue
            found = [form for _, _, form in self.mentions(p)]
            if not found:
                left.append(p)
                continue
            rest = [w for w in p.split() if w not in NOISE and w not in self.regions and not w.isdigit()]
            longer: set[str] = set()
            if len(found) == 1 and len(rest) > len(found[0].split()):  # a misspelt word of a longer name may stand beside the mention
                longer = {n for n in self.similar(" ".join(rest), len(found[0].split()) + 1) if set(found[0].split()) & set(n.split())}
            names |= longer or set().union(*(self.forms[f] for f in found))
        text = " ".join(parts)
        regions = self.region_of(text)
        for p in left:
            if not (regions and self.region_of(p) and not names and len(p.split()) == 1):
                names |= self.similar(p)
        if len(names) != 1:
            return 0
        entries = self.by_name[names.pop()]
        if len(entries) > 1 and regions:
            entries = [e for e in entries if e[1] in regions]
        return entries[0][0] if len(entries) == 1 else 0


def map_values(rows: DataFrame, id_col: str, value_col: str, entries: list[tuple[int, str, str | None]], id_name: str = "record_id", out: str = "city_id") -> DataFrame:
    """record_id, city_id for every row with a non-blank value; 0 for none or several entries.

    NULL and blank values give no row; repeated rows are kept; texts of any length are searched for
    mentions; other columns are ignored. With an empty reference list every value gives 0.
    """
    made: list[Resolver] = []

    @F.pandas_udf("bigint")
    def resolve(values: pd.Series) -> pd.Series:
        if not made:
            made.append(Resolver(entries))
        code, unique = pd.factorize(values)
        ids = [made[0].resolve(u) for u in unique]
        return pd.Series([ids[c] for c in code], dtype="int64")

    has_text = F.regexp_replace(F.col(value_col), r"[\s ﻿]+", "") != ""
    return rows.filter(has_text).select(F.col(id_col).cast("bigint").alias(id_name), resolve(F.col(value_col)).alias(out))


def reference_entries(reference: DataFrame, id_col: str = "city_id", name_col: str = "city_name", group_col: str = "region_name") -> list[tuple[int, str, str | None]]:
    """The reference list on the driver, after a check of its size."""
    rows = reference.select(id_col, name_col, group_col).dropna(subset=[id_col, name_col]).distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a reference list of more than {MAX_ENTRIES} entries")
    return sorted((tuple(r) for r in rows), key=str)


def located_records(tables: dict[str, DataFrame], reference: DataFrame, id_col: str = "id", city_col: str = "city") -> DataFrame:
    """record_table, record_id, city_id of every row of the tables that has a non-blank city."""
    entries = reference_entries(reference)
    found: Callable[[str, DataFrame], DataFrame] = lambda name, df: map_values(df, id_col, city_col, entries).select(F.lit(name).alias("record_table"), "record_id", "city_id")
    frames = [found(name, df) for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
