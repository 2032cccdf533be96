"""Timestamp normalisation against hand-worked instants and a zoneinfo model."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vacantia.operators.timestamps import normalise_timestamps

ZONES = [("pl", "Europe/Warsaw", "dmy"), ("us", "America/New_York", "mdy"), ("gb", "Europe/London", "dmy"), ("none", None, None)]
ZONE_SCHEMA = "source string, tz_name string, date_order string, id bigint, published_at string"


def zones(spark):
    return spark.createDataFrame([(*z, 1, "clash") for z in ZONES], ZONE_SCHEMA)


def run(spark, values, source="pl"):
    rows = [(i, source, v, None, "x") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, source string, published_at string, refreshed_at string, tz_name string")
    got = {r.posting_id: r.utc_us for r in normalise_timestamps(df, zones(spark)).collect()}
    return [got.get(i) for i in range(len(values))]


def us(*fields, micro=0):
    return int(datetime(*fields, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-12-01T03:34:35+01:00", us(2024, 12, 1, 2, 34, 35)),
    ("2024-11-29T08:42:53.536905218Z", us(2024, 11, 29, 8, 42, 53, micro=536905)),
    ("2025-03-08T23:20", us(2025, 3, 8, 22, 20)),
    ("2025-10-20 15:13:47", us(2025, 10, 20, 13, 13, 47)),
    ("2025-04-19T00:57:06.443", us(2025, 4, 18, 22, 57, 6, micro=443000)),
    ("2025-11-25 04:08:22 CET", us(2025, 11, 25, 3, 8, 22)),
    ("2024-10-24 09:16:57 EDT", us(2024, 10, 24, 13, 16, 57)),
    ("2025-02-13 01:06:26+0100", us(2025, 2, 13, 0, 6, 26)),
    ("2024-08-30 20:48 UTC+2", us(2024, 8, 30, 18, 48)),
    ("2024-08-29 13:17 UTC-4", us(2024, 8, 29, 17, 17)),
    ("2024-09-07 07:14 +05:30", us(2024, 9, 7, 1, 44)),
    ("2024-08-30T19:46:33+02:00[Europe/Warsaw]", us(2024, 8, 30, 17, 46, 33)),
    ("2024-09-03T18:07:04Z[UTC]", us(2024, 9, 3, 18, 7, 4)),
    ("20240830T083617Z", us(2024, 8, 30, 8, 36, 17)),
    ("2026/06/20 12:23:53", us(2026, 6, 20, 10, 23, 53)),
    ("27.08.2025 05:19", us(2025, 8, 27, 3, 19)),
    ("19.08.2025, 13:26:42", us(2025, 8, 19, 11, 26, 42)),
    ("30.11.2025 r.", us(2025, 11, 29, 23)),
    ("30.11.2025 r", us(2025, 11, 29, 23)),
    ("21.10.25 18:38", us(2025, 10, 21, 16, 38)),
    ("01-01-2025 06:46", us(2025, 1, 1, 5, 46)),
    ("29/10/2025 06:54", us(2025, 10, 29, 5, 54)),
    ("26 marca 2026, 22:41", us(2026, 3, 26, 21, 41)),
    ("28 lut 2026 21:01", us(2026, 2, 28, 20, 1)),
    ("8 June 2026 7:15 PM", us(2026, 6, 8, 17, 15)),
    ("April 10, 2025 at 1:43 am", us(2025, 4, 9, 23, 43)),
    ("Sun, 15 Sep 2024 22:16:24 GMT", us(2024, 9, 15, 22, 16, 24)),
    ("Fri, 10 Apr 2026 00:08:49 +0530", us(2026, 4, 9, 18, 38, 49)),
    ("godz. 4.02, 22.01.2025 r.", us(2025, 1, 22, 3, 2)),
    ("1762068333132", 1762068333132000),
    ("1745650582", 1745650582000000),
    ("\t 2026-04-22  ", us(2026, 4, 21, 22)),
    # wall times at the changes of 2024-10-27 (twice) and 2025-03-30 (skipped)
    ("2024-10-27T02:16:36.405", us(2024, 10, 27, 0, 16, 36, micro=405000)),
    ("2025-03-30 02:30:00", us(2025, 3, 30, 1, 30)),
    # unreadable
    (None, None), ("", None), ("  ", None), ("2 dni temu", None), ("wczoraj", None), ("0000-00-00 00:00:00", None),
    ("2026-06-31 07:00", None), ("31.02.2025", None), ("2025-01-01 24:00", None), ("2025-01-01 10:60", None),
    ("13/13/2025 10:00", None), ("8 Juny 2026", None), ("--.--.----", None), ("2025-01-01T10:00 XYZ", None),
    ("x" * 100_000, None), ("2025-01-01 13:00 PM", None), ("13/01/2025 13:00 PM", None),
]


def test_hand_worked_cases(spark):
    assert run(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_source_decides_date_order_and_zone(spark):
    assert run(spark, ["04/15/2025 5:10 AM", "12/13/2024 9:56 AM"], "us") == [us(2025, 4, 15, 9, 10), us(2024, 12, 13, 14, 56)]
    assert run(spark, ["2025-01-01 10:00", "2025-01-01 10:00Z"], "none") == [None, us(2025, 1, 1, 10)]
    assert run(spark, ["2025-01-01 10:00", "1745650582"], None) == [None, 1745650582000000]


def test_repeated_rows_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "pl", "2025-01-01", "2025-01-01", 5)] * 2, "id bigint, source string, published_at string, refreshed_at string, utc_us bigint")
    out = normalise_timestamps(df, zones(spark).union(zones(spark)))
    assert out.columns == ["posting_id", "field_name", "utc_us"]
    assert sorted(r.field_name for r in out.collect()) == ["published_at"] * 2 + ["refreshed_at"] * 2
    assert normalise_timestamps(df.limit(0), zones(spark)).count() == 0
    assert normalise_timestamps(df, zones(spark).limit(0)).count() == 0


@pytest.mark.parametrize("source,zone", [(z[0], z[1]) for z in ZONES[:3]])
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_wall_times_agree_with_zoneinfo(spark, source, zone, data):
    walls = data.draw(st.lists(st.datetimes(datetime(2023, 1, 1), datetime(2027, 1, 1)), min_size=30, max_size=30))
    for day in (datetime(2025, 3, 9), datetime(2025, 3, 30), datetime(2025, 10, 26), datetime(2025, 11, 2)):
        walls += [day + timedelta(minutes=m) for m in range(0, 240, 10)]
    walls = [w.replace(microsecond=0) for w in walls]
    want = []
    for w in walls:
        aware = w.replace(tzinfo=ZoneInfo(zone), fold=0)
        want.append(int((w - aware.utcoffset()).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000)
    assert run(spark, [w.strftime("%Y-%m-%d %H:%M:%S") for w in walls], source) == want
