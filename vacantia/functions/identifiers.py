"""Identifiers of firms: validity by kind, and which of them are strong enough to key by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits that registers' numbers may have.
REGISTER_LENGTHS = {"nip": (10,), "regon": (9, 14), "krs": (10,)}
STRONG_CONFIDENCE = 0.95


def identifier_kind(kind: Column) -> Column:
    return F.nullif(F.lower(F.trim(kind)), F.lit(""))


def identifier_value(kind: Column, value: Column) -> Column:
    """The normalised value, NULL where it isn't valid for its (normalised) kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    other = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    out = None
    for name, lengths in REGISTER_LENGTHS.items():
        valid = F.when(F.length(digits).isin(*lengths), digits)
        out = F.when(kind == name, valid) if out is None else out.when(kind == name, valid)
    return out.otherwise(F.when(F.length(other).between(2, 128), other))


def is_strong(kind: Column, confidence: Column) -> Column:
    """Whether an identifier may key a firm: a register's number or an employer's profile, sure enough."""
    return (confidence >= STRONG_CONFIDENCE) & (kind.isin(*REGISTER_LENGTHS) | kind.endswith("employer_profile"))
