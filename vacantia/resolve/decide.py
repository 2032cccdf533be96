"""Which known firm a posting belongs to: exact signals only, conservatively."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

# Single words too general to tell firms of different places apart.
GENERAL_WORDS = frozenset("firma company group polska service services sklep hotel restaurant restauracja transport budownictwo".split())
SURE = 0.8


@dataclass
class Firm:
    """A known firm; `name` never changes after it was made."""

    seq: int
    key: str
    name: str
    shown: str
    city: str | None
    city_shown: str | None
    source: str | None
    confidence: float


def is_distinctive(name: str) -> bool:
    words = name.split()
    letters = sum(map(len, words))
    return letters >= 5 if len(words) > 1 else letters >= 6 and name not in GENERAL_WORDS


def decide(name: str, city: str | None, confidence: float, namesakes: list[Firm]) -> tuple[Firm | None, str, float]:
    """(firm or None, method, confidence) for a posting whose firm's normalised name is `name`."""
    local = [f for f in namesakes if city is not None and f.city == city]
    if len(local) == 1:
        return local[0], "exact_name_city", 1.0
    if len(namesakes) != 1:
        return None, "ambiguous_exact_name" if namesakes else "new_company", confidence
    (only,) = namesakes
    weakest = min(confidence, only.confidence)
    if weakest < SURE or not is_distinctive(name):
        return None, "insufficient_cross_city_evidence", weakest
    return (only, "exact_name_partial_location", 0.92) if city is None or only.city is None else (only, "exact_name_cross_city", 0.88)


def fallback_key(name: str, city: str | None, city_given: bool, source: str, source_id: str, method: str, strong: str | None) -> str:
    """The key that a posting without a firm is filed under."""
    if strong:
        kind, value = strong.split(":", 1)
        return f"strong-id:{kind}:{hashlib.sha1(strong.encode()).hexdigest()[:20]}" if value else strong
    base = f"{name}|{city}" if city else name
    return base if city_given else f"{base}|unknown:{hashlib.sha1(f'{source}:{source_id}'.encode()).hexdigest()[:12]}|{method}"
