"""Problem 3: groups of companies that share identifiers, directly or over several steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.union_find import PER_TASK, tied_groups

# Digits of the registers' numbers.
REGISTER_DIGITS = {"nip": 10, "regon": 9, "krs": 10}


def identifier_key(kind: Column, value: Column) -> Column:
    """What an identifier ties by; NULL where it ties nothing.

    Register numbers are their digits, of the register's length. One digit repeated and digits that
    count up or down by one (with 0 after 9) are filler. Profile addresses lose scheme, letter case
    of the host, query, fragment and closing slashes. NULL, empty and other values tie nothing.
    """
    k = F.lower(F.trim(kind))
    digits = F.regexp_replace(value, "[^0-9]", "")
    width = F.when(k == "regon", 9).when(k.isin("nip", "krs"), 10)
    filler = digits.rlike(r"^(\d)\1+$") | F.lit("01234567890123456789").contains(digits) | F.lit("98765432109876543210").contains(digits)
    address = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#\s]+)([^?#\s]*)(?:[?#].*)?\s*$"
    profile = F.concat(F.lower(F.regexp_extract(value, address, 1)), F.regexp_replace(F.regexp_extract(value, address, 2), "/+$", ""))
    return F.when(k.isin(*REGISTER_DIGITS), F.when((F.length(digits) == width) & ~filler, F.concat(k, F.lit(":"), digits))).when(
        k.endswith("_employer_profile") & (profile != "") & profile.contains("/"), F.concat(k, F.lit(":"), profile)
    )


def identifier_groups(observations: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """company_id, group_id of every company tied to another one.

    `observations` needs company_id, kind and value. Cases of NULL, repeated rows, empty tables and
    clashing names: see `tied_groups` and `identifier_key`.
    """
    groups = tied_groups(observations, F.col("company_id"), identifier_key(F.col("kind"), F.col("value")), per_task)
    return groups.withColumnRenamed("node", "company_id")
