"""Normalising timestamps written in many formats and zones to one UTC instant.

`normalise_timestamps` is an ordered cascade of anchored patterns. A text is trimmed, then the
first pattern that matches it whole decides how its fields are read; the fields are then checked
strictly (no 31 June, no hour 24, no second 60). Everything is built from native column
expressions, so a job is one scan with a twelve-row dimension join and no Python.

Rules for the wall-time cases:

* no zone in the text: the zone of the row's source (lookup table) holds; without one, no instant;
* a wall time that occurs twice means the first occurrence;
* a wall time that is skipped counts with the offset in force before the change;
* a bare date is its midnight; digits beyond microseconds are cut;
* relative times, words and impossible dates give NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names as written in Polish (nominative, genitive, three letters) and English.
MONTHS: dict[str, int] = {
    "styczeń": 1, "stycznia": 1, "sty": 1, "january": 1, "jan": 1,
    "luty": 2, "lutego": 2, "lut": 2, "february": 2, "feb": 2,
    "marzec": 3, "marca": 3, "mar": 3, "march": 3,
    "kwiecień": 4, "kwietnia": 4, "kwi": 4, "april": 4, "apr": 4,
    "maj": 5, "maja": 5, "may": 5,
    "czerwiec": 6, "czerwca": 6, "cze": 6, "june": 6, "jun": 6,
    "lipiec": 7, "lipca": 7, "lip": 7, "july": 7, "jul": 7,
    "sierpień": 8, "sierpnia": 8, "sie": 8, "august": 8, "aug": 8,
    "wrzesień": 9, "września": 9, "wrz": 9, "september": 9, "sep": 9, "sept": 9,
    "październik": 10, "października": 10, "paź": 10, "october": 10, "oct": 10,
    "listopad": 11, "listopada": 11, "lis": 11, "november": 11, "nov": 11,
    "grudzień": 12, "grudnia": 12, "gru": 12, "december": 12, "dec": 12,
}

# Zone abbreviations and their offsets in minutes.
ZONE_MINUTES: dict[str, int] = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
}

_DATE = r"(\d{4})-(\d{1,2})-(\d{1,2})"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:\s*(Z|[A-Za-z]{3,4}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?))?(?:\[[A-Za-z_/+-]+\])?"
_WORD = r"(\p{L}+)\.?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"


@dataclass(frozen=True)
class Pattern:
    """One anchored format: `fields` names the regex groups in order.

    Names: y, y2 (two digits), mo, name (month word), d, a/b (day and month in the order of the
    source), h, mi, s, f (fraction), half (A or P), zone.
    """

    regex: str
    fields: tuple[str, ...]


# The cascade, most specific first. Every pattern is matched against the whole trimmed text.
CASCADE: tuple[Pattern, ...] = (
    Pattern(_DATE + r"(?:[T ]\s*" + _TIME + _ZONE + r")?", ("y", "mo", "d", "h", "mi", "s", "f", "zone")),
    Pattern(r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ZONE, ("y", "mo", "d", "h", "mi", "s", "f", "zone")),
    Pattern(r"(\d{4})/(\d{1,2})/(\d{1,2})(?:\s+" + _TIME + _ZONE + r")?", ("y", "mo", "d", "h", "mi", "s", "f", "zone")),
    Pattern(r"(\d{1,2})[.-](\d{1,2})[.-](\d{4})(?:\s*r\.?)?(?:,?\s*" + _TIME + _ZONE + r")?", ("d", "mo", "y", "h", "mi", "s", "f", "zone")),
    Pattern(r"(\d{1,2})\.(\d{1,2})\.(\d{2})(?:\s*r\.?)?(?:,?\s*" + _TIME + _ZONE + r")?", ("d", "mo", "y2", "h", "mi", "s", "f", "zone")),
    Pattern(r"(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?" + _HALF + r")?", ("a", "b", "y", "h", "mi", "s", "half")),
    Pattern(r"(?:\p{L}+,?\s+)?(\d{1,2})\s+" + _WORD + r"\s+(\d{4})(?:\s*r\.?)?(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?" + _HALF + _ZONE + r")?", ("d", "name", "y", "h", "mi", "s", "half", "zone")),
    Pattern(_WORD + r"\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?" + _HALF + _ZONE + r")?", ("name", "d", "y", "h", "mi", "s", "half", "zone")),
    Pattern(r"(?i:godz)\.?\s*(\d{1,2})[.:](\d{2}),?\s+(\d{1,2})\.(\d{1,2})\.(\d{4})(?:\s*r\.?)?", ("h", "mi", "d", "mo", "y")),
)

#: Unix times: ten digits are seconds, thirteen milliseconds, sixteen microseconds.
EPOCH = r"^(\d{10}|\d{13}|\d{16})$"
#: Two-digit years are read as 2000 to 2099.
CENTURY = 2000


#: Slots that every pattern's groups are rearranged into, separated by bars.
SLOTS = ("y", "mo", "d", "h", "mi", "s", "f", "zone", "half")


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r\u00a0\ufeff"))


def _rearranged(p: Pattern, monthly: bool) -> str:
    """The replacement that puts the groups of `p` into SLOTS."""
    at = {name: f"${i + 1}" for i, name in enumerate(p.fields)}
    if "y2" in at:
        at["y"] = f"{CENTURY // 100}{at['y2']}"
    if "name" in at:
        at["mo"] = at["name"]
    if "a" in at:
        at["d"], at["mo"] = (at["b"], at["a"]) if monthly else (at["a"], at["b"])
    return "|".join(at.get(slot, "") for slot in SLOTS)


def slots(t: Column, date_order: Column) -> Column:
    """The fields of the first pattern that matches the whole of `t`, as an array in SLOTS' order."""
    out = None
    for p in CASCADE:
        for monthly in (True, False) if "a" in p.fields else (False,):
            fits = t.rlike(f"^{p.regex}$") & (date_order.eqNullSafe("mdy") if monthly else F.lit(True))
            then = F.regexp_replace(t, f"^{p.regex}$", _rearranged(p, monthly))
            out = F.when(fits, then) if out is None else out.when(fits, then)
    return F.split(out, r"\|")


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of a written zone; NULL where it is not known."""
    digits = F.regexp_replace(zone, r"^(?:UTC|GMT)?[+-]|:", "")
    long = F.length(digits) > 2
    hours = F.when(long, F.substring(digits, F.lit(1), F.length(digits) - 2)).otherwise(digits).try_cast("int")
    minutes = F.when(long, F.substring(digits, -2, 2).try_cast("int")).otherwise(0)
    east = F.when((hours <= 18) & (minutes < 60), hours * 60 + minutes)
    return F.coalesce(F.try_element_at(_literal_map(ZONE_MINUTES), F.upper(zone)), F.when(zone.contains("-"), -east).otherwise(east))


def instant(parts: Column, t: Column, zone_name: Column) -> Column:
    """UTC microseconds of the slots `parts`, or of the Unix time `t`; NULL where a field is out of range."""
    g = {name: parts[i] for i, name in enumerate(SLOTS)}
    number = {k: g[k].try_cast("int") for k in ("y", "d", "h", "mi", "s")}
    month = F.coalesce(g["mo"].try_cast("int"), F.try_element_at(_literal_map(MONTHS), F.lower(g["mo"])))
    hour, minute, second = (F.coalesce(number[k], F.lit(0)) for k in ("h", "mi", "s"))
    half = F.upper(g["half"])
    ok = (number["y"] >= 1) & (hour < 24) & (minute < 60) & (second < 60) & ((half == "") | hour.between(1, 12))
    clock = F.when(half == "", hour).when(half == "P", hour % 12 + 12).otherwise(hour % 12)
    wall = F.when(ok, F.try_make_timestamp(number["y"], month, number["d"], clock, minute, second.cast("decimal(16,6)"), F.lit("UTC")))
    fraction = F.rpad(g["f"], 6, "0").cast("int")
    zoned = F.unix_micros(wall) - _offset_minutes(g["zone"]).cast("long") * 60_000_000
    local = F.unix_micros(F.to_utc_timestamp(wall, zone_name))
    epoch = F.when(t.rlike(EPOCH), t.try_cast("long") * F.when(F.length(t) == 10, 1_000_000).when(F.length(t) == 13, 1_000).otherwise(1))
    return F.coalesce(F.when(g["zone"] == "", local).otherwise(zoned) + fraction, epoch)


def normalise_timestamps(
    df: DataFrame, zones: DataFrame, id_col: str = "id", source_col: str = "source", fields: tuple[str, ...] = ("published_at", "refreshed_at")
) -> DataFrame:
    """One row per readable value: posting_id, field_name, utc_us.

    `zones` has one row per source with source, tz_name and date_order; repeated sources count
    once (the smallest row). Rows whose source is NULL or not listed still yield values that carry
    a zone of their own. Repeated input rows give repeated output rows; an empty table gives an
    empty result; other columns of either table, whatever they are called, are ignored.
    """
    lookup = zones.groupBy(F.col("source").alias("_src")).agg(F.min(F.struct("tz_name", "date_order")).alias("_zone"))
    n = range(len(fields))
    rows = df.select(F.col(id_col).alias("posting_id"), F.col(source_col).alias("_src"), *[trimmed(F.col(f)).alias(f"_t{i}") for i, f in enumerate(fields)])
    rows = rows.filter(" or ".join(f"_t{i} is not null" for i in n)).join(lookup, "_src", "left")
    rows = rows.withColumns({f"_p{i}": slots(F.col(f"_t{i}"), F.col("_zone.date_order")) for i in n})
    rows = rows.withColumns({f"_u{i}": instant(F.col(f"_p{i}"), F.col(f"_t{i}"), F.col("_zone.tz_name")) for i in n})
    found = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_u{i}").alias("utc_us")) for i, f in enumerate(fields)])
    # The array is filtered before it is spread, as a filter behind it would be pushed down and parse twice.
    return rows.select("posting_id", F.inline(F.filter(found, lambda x: x["utc_us"].isNotNull())))
