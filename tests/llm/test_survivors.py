"""Survivors against a plain sort of every group and against layers peeled one by one."""

import math
import random
from datetime import datetime, timedelta, timezone

from vacantia.llm.survivors import company_survivors, website_host

SCHEMA = "id bigint, normalized_name string, normalized_city string, identity_source string, identity_confidence double, website_url string, updated_at timestamp, trust_rank string, host string"
SOURCES = {"official_feed": 1, "listing_card": 2, "csv_import": 3}


def dims(spark):
    trust = spark.createDataFrame([(s, r, "x") for s, r in SOURCES.items()] + [("official_feed", 9, "x")], "identity_source string, trust_rank int, updated_at string")
    portals = spark.createDataFrame([("uk.portal.example", 1), ("www.jobs.example", 1)], "host string, id int")
    return trust, portals


def fold(s):
    return "_".join(s.strip().lower().replace("-", " ").replace("_", " ").split()) if s else None


def model(rows):
    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups.setdefault((r[1], r[2]), []).append(r)
    out = set()
    for rs in groups.values():
        if len(rs) < 2:
            continue
        conf = lambda r: r[4] if r[4] is not None and not math.isnan(r[4]) and 0 <= r[4] <= 1 else None
        rank = lambda r: SOURCES.get(fold(r[3]))
        rs = sorted(rs, key=lambda r: (rank(r) or 99, -(conf(r) if conf(r) is not None else -1), -(r[6].timestamp() if r[6] else -1e12), r[0]))
        web = [r[0] for r in rs if r[5] == "https://own.example"]
        known = [r[0] for r in rs if rank(r) and conf(r) is not None]
        out.add((min(r[0] for r in rs), web[0] if web else 0, known[0] if known else 0))
    return out


def rows_of(seed, n, groups):
    rng = random.Random(seed)
    base = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(n):
        rows.append((
            i + 1, rng.choice([*(f"g{k}" for k in range(groups)), "hot", "hot", None]), rng.choice(["c", "c", "c", None]),
            rng.choice(["official_feed", " Official-Feed ", "LISTING CARD", "csv_import", "legacy", "", None]),
            rng.choice([None, float("nan"), -0.2, 1.7, 0.0, 1.0, round(rng.random(), 2), round(rng.random(), 3)]),
            rng.choice([None, "", "https://own.example", "https://uk.portal.example/x", "jobs.example"]),
            rng.choice([None, base + timedelta(days=rng.randrange(30))]), "clash", "clash",
        ))
    return rows


def test_random_groups_with_ties_nulls_and_a_hot_group(spark):
    for seed, n, groups in ((1, 400, 60), (2, 600, 5), (3, 3, 1)):
        rows = rows_of(seed, n, groups)
        got = company_survivors(spark.createDataFrame(rows, SCHEMA).repartition(5), *dims(spark)).collect()
        assert {tuple(r) for r in got} == model(rows) and len(got) == len(model(rows))


def test_layers_peeled_one_by_one_give_the_same():
    """Skylines of all records of a group, peeled one by one; the policy picks within the first layer that has the field."""
    rng = random.Random(11)
    for _ in range(300):
        # has, trust, -confidence, -recency, id: less is better, a record that has the field is the better one
        rs = [(rng.randrange(2), rng.randrange(3), -rng.randrange(3), -rng.randrange(4), i) for i in range(rng.randrange(1, 14))]
        better = lambda a, b: a[0] >= b[0] and all(x <= y for x, y in zip(a[1:4], b[1:4])) and a[:4] != b[:4]
        left, filled, layer = list(rs), None, 0
        while left and filled is None:
            layer += 1
            top = [r for r in left if not any(better(o, r) for o in left)]
            filled = min((r[1:] for r in top if r[0]), default=None)
            left = [r for r in left if r not in top]
        assert filled == min((r[1:] for r in rs if r[0]), default=None) and (filled is None or layer == 1)


def test_empty_tables_and_repeated_rows(spark):
    rows = rows_of(4, 40, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    trust, portals = dims(spark)
    assert company_survivors(df.limit(0), trust, portals).count() == 0
    assert all(r.identity_company_id == 0 for r in company_survivors(df, trust.limit(0), portals.limit(0)).collect())
    single = spark.createDataFrame([rows_of(5, 1, 1)[0][:1] + ("n", "c") + rows_of(5, 1, 1)[0][3:]] * 2, SCHEMA)
    assert company_survivors(single, trust, portals).count() == 1


def test_hosts(spark):
    cases = {
        "https://kontakt.example/a": "kontakt.example", "WWW.Abc.example": "abc.example", "http://www.abc.example:80/pl?x": "abc.example", "//abc.example.": "abc.example",
        "https://żółw.example": "żółw.example", "https:///kontakt": None, "https://www": None, "http://localhost/": None, "n/d": None, "-": None, "": None,
        "info@abc.example": None, "biuro(at)abc.example": None, "https://{{slug}}.example": None, "{{website}}": None, "w budowie": None, "x" * 50000: None,
    }
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", website_host(F.col("u")).alias("h"))
    assert {r.u: r.h for r in df.collect()} == cases
