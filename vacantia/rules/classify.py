"""What a contact is for, by an ordered table of rules.

A rule is (purpose, decision, confidence, signal, test). Two orders of the same rules serve texts
around a contact and forms. The tables drive both a native column expression and a Python
function for use inside HTML extraction; the first rule whose test holds decides.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import FOLD_FROM, FOLD_TO
from vacantia.rules import phrases as ph


@dataclass(frozen=True)
class Rule:
    """Decides for `purpose` when one of `any_of` stands in the text; `also` names a further condition."""

    purpose: str
    decision: str
    confidence: float
    any_of: tuple[str, ...]
    signal: str = ""
    also: str = ""


def _each(words, purpose: str, decision: str, confidence: float, also: str = "") -> list[Rule]:
    return [Rule(purpose, decision, confidence, (w,), w, also) for w in words]


_RULES = {
    "forbidden": _each(ph.FORBIDDEN, "negative", "ignore", 0.99),
    "privacy": [Rule("privacy", "ignore", 0.98, ph.PRIVACY, "privacy")],
    "stated": [r for purpose, words in ph.STATED.items() for r in _each(words, purpose, "green", 0.95)],
    "consent": _each(ph.CONSENT, "sales", "review", 0.78),
    "recruitment": [Rule("recruitment", "ignore", 0.94, ph.RECRUITMENT, "recruitment")],
    "for_firms": _each(ph.FOR_FIRMS, "business_partnership", "green", 0.95, "partner mailbox or path"),
    "form_for_firms": _each(ph.FOR_FIRMS, "business_partnership", "green", 0.95, "path"),
    "support": [Rule("support", "ignore", 0.90, ph.SUPPORT, "support")],
    "mailbox": [Rule("", "review", 0.82, (), "mailbox", "mailbox")],
    "hints": [Rule(p, "review", 0.72, (w,), w) for w, p in ph.HINTS],
}
CONTEXT_ORDER = ("forbidden", "privacy", "stated", "consent", "recruitment", "for_firms", "support", "mailbox", "hints")
FORM_ORDER = ("forbidden", "recruitment", "support", "consent", "stated", "form_for_firms", "hints", "privacy")
OTHERWISE = ("generic", "review", 0.40, "generic")
_MAILBOX = {word: purpose for purpose, words in ph.MAILBOXES.items() for word in words}
_DISCOVERY = tuple(w for ws in ph.STATED.values() for w in ws) + tuple(w for w, _ in ph.HINTS) + ph.FOR_FIRMS + ph.CONSENT + ph.FORBIDDEN


def pattern(phrase: str) -> str:
    """A phrase as whole words with any blanks between them; with an @ it may stand anywhere."""
    return re.escape(phrase) if "@" in phrase else r"(?<!\w)" + r"\s+".join(map(re.escape, phrase.split())) + r"(?!\w)"


def any_pattern(words: tuple[str, ...]) -> str:
    return "|".join(map(pattern, words))


def fold_signs(text: str) -> str:
    """Lower case without accents; signs stay, blanks collapse."""
    t = unicodedata.normalize("NFKD", text.replace("Ł", "L").replace("ł", "l"))
    return re.sub(r"\s+", " ", "".join(c for c in t if not unicodedata.combining(c)).lower()).strip()


_COMPILED = {r: re.compile(any_pattern(r.any_of)) for rules in _RULES.values() for r in rules if r.any_of}
#: The first words of each rule's phrases: none of them in a text, no phrase in it.
_FIRST = {r: tuple({w.split()[0] for w in r.any_of}) for r in _COMPILED}
_ANY_DISCOVERY, _FIRST_DISCOVERY = re.compile(any_pattern(_DISCOVERY)), tuple({w.split()[0] for w in _DISCOVERY})


def mailbox_purpose(value: str) -> tuple[str, str] | None:
    """(purpose, word) of a mail address's name, whole or by its parts."""
    if "@" not in value:
        return None
    name = fold_signs(value.split("@", 1)[0])
    for part in [name, *re.split(r"[._+\-\s]+", name)]:
        word = re.sub(r"[^a-z0-9]", "", part)
        if word in _MAILBOX:
            return _MAILBOX[word], word
    return None


def classify(context: str, value: str = "", form: bool = False) -> tuple[str, str, float, str]:
    """(purpose, decision, confidence, signal) of a contact with this text around it."""
    text = fold_signs(f"{context} {value}")
    box = mailbox_purpose(value)
    path = any(p in text for p in ph.PATHS_FOR_FIRMS)
    for kind in FORM_ORDER if form else CONTEXT_ORDER:
        for r in _RULES[kind]:
            if r.also == "mailbox":
                if box:
                    return box[0], r.decision, r.confidence, f"localpart:{box[1]}"
            elif any(w in text for w in _FIRST[r]) and _COMPILED[r].search(text) and (not r.also or path or (r.also.startswith("partner") and bool(box) and box[0] == "business_partnership")):
                return r.purpose, r.decision, r.confidence, r.signal
    return OTHERWISE


def has_discovery_signal(text: str) -> bool:
    folded = fold_signs(text)
    return any(w in folded for w in _FIRST_DISCOVERY) and _ANY_DISCOVERY.search(folded) is not None


def classified(context: Column, value: Column, form: bool = False) -> Column:
    """`classify` as a struct column of native expressions (purpose, decision, confidence, signal).

    The folded text is bound once by a lambda, so the rules search it without folding it again.
    """
    text = F.concat_ws(" ", context, value)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), r"\p{M}+", ""), r"\s+", " "))
    name = F.regexp_extract(F.translate(F.lower(F.coalesce(value, F.lit(""))), FOLD_FROM, FOLD_TO), "^([^@]*)@", 1)
    parts = F.filter(F.transform(F.concat(F.array(name), F.split(name, r"[._+\-\s]+")), lambda p: F.regexp_replace(p, "[^a-z0-9]", "")), lambda p: p.isin(*_MAILBOX))
    bound = F.array(F.struct(text.alias("text"), F.try_element_at(parts, F.lit(1)).alias("word")))
    return F.transform(bound, lambda x: _decided(x["text"], x["word"], form))[0]


def _decided(text: Column, word: Column, form: bool) -> Column:
    """The first rule that holds for a folded text and a mailbox word (NULL for none)."""
    box = F.try_element_at(F.create_map(*[F.lit(x) for pair in _MAILBOX.items() for x in pair]), word)
    path = text.rlike("|".join(map(re.escape, ph.PATHS_FOR_FIRMS)))

    def made(purpose: Column, decision: str, confidence: float, signal: Column) -> Column:
        return F.struct(purpose.alias("purpose"), F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"), signal.alias("signal"))

    out = F.when(F.lit(False), made(F.lit(""), "", 0.0, F.lit("")))
    for kind in FORM_ORDER if form else CONTEXT_ORDER:
        for r in _RULES[kind]:
            if r.also == "mailbox":
                out = out.when(word.isNotNull(), made(box, r.decision, r.confidence, F.concat(F.lit("localpart:"), word)))
                continue
            fits = text.rlike("(?U)" + any_pattern(r.any_of))
            if r.also:
                fits &= path | (F.coalesce(box == "business_partnership", F.lit(False)) if r.also.startswith("partner") else F.lit(False))
            out = out.when(fits, made(F.lit(r.purpose), r.decision, r.confidence, F.lit(r.signal)))
    return out.otherwise(made(F.lit(OTHERWISE[0]), OTHERWISE[1], OTHERWISE[2], F.lit(OTHERWISE[3])))
