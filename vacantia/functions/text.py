"""Text normalisation as native column expressions, with a full-fidelity Arrow variant."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal forms as they read after folding, longest first.
LEGAL_FORMS = (
    r"spolka\s+komandytowo\s+akcyjna", r"spolka\s+z\s+ograniczona\s+odpowiedzialnoscia", r"spolka\s+akcyjna", r"spolka\s+komandytowa", r"spolka\s+jawna", r"spolka\s+cywilna",
    r"sp\s*z\s*o\s*o", r"sp\s*k\s*a", r"sp\s*j", r"sp\s*k", r"s\s*c", r"s\s*a", r"sa", r"limited\s+liability\s+company", r"limited\s+liability", r"ltd", r"llc", r"incorporated", r"inc", r"gmbh",
)
_LEGAL = re.compile("|".join(rf"\b(?:{p})\b" for p in LEGAL_FORMS))


def _fold_table() -> tuple[str, str]:
    """Lower-case letters that NFKD folds to one ASCII letter, and those letters."""
    source, target = ["ł"], ["l"]
    for code in range(0x80, 0x1F00):
        c = chr(code)
        if c.isalpha() and c == c.lower():
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base.isascii() and base.isalpha():
                source.append(c)
                target.append(base.lower())
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def folded(text: Column) -> Column:
    """Lower-case ASCII words of `text`, one blank between two; NULL stays NULL."""
    plain = F.translate(F.lower(F.trim(text)), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), "[^a-z0-9]+", " "))


def fold_text(value: str) -> str:
    """The same in Python, with the compatibility characters that `folded` leaves out."""
    v = unicodedata.normalize("NFKD", value.strip().lower().replace("ł", "l"))
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in v if not unicodedata.combining(c))).strip()


def firm_name(value: str) -> str:
    """The folded name without legal forms, which may stand anywhere and uncover each other."""
    name = fold_text(value)
    while True:
        shorter = re.sub(r"\s+", " ", _LEGAL.sub(" ", name)).strip()
        if shorter == name:
            return name
        name = shorter


@F.pandas_udf(StringType())
def firm_names(values: pd.Series) -> pd.Series:
    """`firm_name` over a column; distinct values of a batch are read once."""
    known = {v: firm_name(v) for v in values.dropna().unique()}
    return pd.Series([known.get(v) for v in values], dtype=object)


#: All legal forms as one pattern of whole words.
LEGAL_PATTERN = r"\b(?:" + "|".join(LEGAL_FORMS) + r")\b"


def without_legal_forms(folded_name: Column) -> Column:
    """Native form of `firm_name` for folded names: passes of one pattern until nothing is left to take away.

    A pass that changes a name takes a word of it at least, so there are as many passes as words; most end with the first two.
    """

    def once(name: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(name, LEGAL_PATTERN, " "), r"\s+", " "))

    def step(held: Column, _: Column) -> Column:
        return F.when(held["done"], held).otherwise(F.transform(F.array(once(held["name"])), lambda x: F.struct(x.alias("name"), (x == held["name"]).alias("done")))[0])

    first = F.struct(folded_name.alias("name"), F.lit(False).alias("done"))
    return F.aggregate(F.split(folded_name, " "), first, step, lambda held: held["name"])


def firm_key(name: Column, city: Column) -> Column:
    """name|city of normalised parts, or the name alone."""
    return F.concat_ws("|", name, F.nullif(city, F.lit("")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
