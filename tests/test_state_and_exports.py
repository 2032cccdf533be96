"""State operators, sampling, exports and streams on small inputs."""

import hashlib
import json
import zipfile

import pytest

from pyspark.sql import functions as F

from vacantia.evaluation import metrics, sampling
from vacantia.operators import state
from vacantia.sinks.files import write_bundle, write_csv, write_export, write_xlsx
from vacantia.streaming import ingest


def test_changes_and_first_accepted(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 2, "a"), (5, 2, None)], "id int, k int, v string")
    assert [(r.id, r.changed) for r in state.changes(df, "k", "v", ["id"]).orderBy("id").collect()] == [(1, False), (2, False), (3, True), (4, False), (5, False)]
    tries = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False)], "k int, rank int, ok boolean")
    assert sorted((r.k, r["rank"]) for r in state.until_first_accepted(tries, "k", "rank", "ok").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_pairwise_measure_equals_all_pairs(spark):
    rows = [(i, f"t{i % 7}", f"p{i % 5}") for i in range(80)] + [(99, None, "p1")]
    got = metrics.pairwise(spark.createDataFrame(rows, "i int, t string, p string"), F.col("t"), F.col("p")).first()
    r = rows[:-1]
    pairs = [(a, b) for i, a in enumerate(r) for b in r[:i]]
    both, t, p = (sum(f(a, b) for a, b in pairs) for f in (lambda a, b: a[1:] == b[1:], lambda a, b: a[1] == b[1], lambda a, b: a[2] == b[2]))
    assert (got.both, got.in_truth, got.in_prediction) == (both, t, p) and abs(got.precision - both / p) < 1e-12


def test_samples_are_exact_and_independent_of_partitions(spark):
    rows = [(i, f"s{i % 10 if i % 3 else 0}") for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    for limit in (3, 10, 57, 5000):
        a, b = (sorted(r.id for r in sampling.stratified_sample(df.repartition(n), F.col("id"), F.col("s"), limit, "x").collect()) for n in (1, 7))
        assert a == b and len(a) == min(limit, 500)
        if 10 <= limit < 500:
            assert len({i % 10 if i % 3 else 0 for i in a}) == 10
    digest = lambda i: hashlib.sha256(f"x\x1frow\x1f{i}".encode()).hexdigest()
    mine = [i for i in a if (i % 10 if i % 3 else 0) == 4]
    assert len(mine) == len([1 for i, s in rows if s == "s4"])
    b = [r.id for r in sampling.stratified_sample(df, F.col("id"), F.lit("one"), 5, "x").collect()]
    assert sorted(b) == sorted(sorted(range(500), key=digest)[:5])


def test_bundle_and_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", ł', None), (2, "", "x\ny")], "id int, t string, n string")
    m = write_bundle({"rows": df}, str(tmp_path / "b"), notes=["n"])
    data = (tmp_path / "b" / "rows.csv").read_bytes()
    assert data.startswith("﻿id,t,n\n".encode()) and m["files"] == {"rows.csv": 2} and json.loads((tmp_path / "b" / "manifest.json").read_text())["schema_version"] == 8
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if not p.name.startswith(".")) == ["manifest.json", "rows.csv"]
    assert write_csv(df.limit(1), str(tmp_path / "b" / "rows.csv")) == 1 and write_export(df, f"file://{tmp_path}/j", "json") == 2
    with pytest.raises(ValueError):
        write_export(df, str(tmp_path / "x"), "parquet")
    with pytest.raises(ValueError):
        write_xlsx(df, str(tmp_path / "b.xlsx"), most_rows=1)
    assert write_xlsx(df.select("*", *[F.lit(i).alias(f"c{i}") for i in range(30)]), str(tmp_path / "wide.xlsx")) == 2
    with zipfile.ZipFile(tmp_path / "wide.xlsx") as z:
        assert 'ref="A1:AG3"' in z.read("xl/worksheets/sheet1.xml").decode()
    assert write_xlsx(df, str(tmp_path / "a.xlsx")) == 2
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert "ł" in z.read("xl/worksheets/sheet1.xml").decode()


def test_a_stream_gives_the_view_of_one_batch_and_replays_harmlessly(spark, tmp_path):
    rows = [(i, "a", str(i % 7), f"u{i}", "t", "c", None, "d", None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, source string, source_id string, url string, title string, company_name_raw string, city string, description string, published_at string, refreshed_at string").withColumn("observed_at", F.timestamp_seconds("id"))
    for n in range(4):
        df.filter(F.col("id") % 4 == n).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = ingest.stream_of(spark, str(tmp_path / "in"), df.schema)
    ingest.ingest(stream, str(tmp_path / "log"), str(tmp_path / "state"))
    ingest.ingest(stream, str(tmp_path / "log"), str(tmp_path / "state"))
    log = spark.read.schema(df.schema).parquet(str(tmp_path / "log"))
    assert log.count() == 40 and sorted(state.current_postings(log).collect()) == sorted(state.current_postings(df).collect())
    once = ingest.first_sightings(stream)
    once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 7


def test_nested_attempts(spark):
    from vacantia.operators import attempts as at

    page = "page_snapshots: array<struct<url: string, status_code: int>>"
    rows = [
        (1, [("u", "source_candidate", "s", False, [("p", 200), ("q", 404)]), ("v", "search", "x", True, [("r", 200)])], [("own", 200)]), (2, [("v", "search", "x", True, []), ("u", "source_candidate", "s", False, [])], []),
        (3, [("u", "source_candidate", "s", True, None)], None), (4, [], [("own", 200)]), (5, None, [("own", 500)]),
    ]
    df = spark.createDataFrame(rows, f"run_id int, attempts: array<struct<url: string, origin: string, source: string, accepted: boolean, {page}>>, {page}".replace("attempts:", "attempts").replace(", page_snapshots:", ", page_snapshots"))
    assert [tuple(r) for r in at.attempt_metrics(df).collect()] == [("s", 3, 1, 2, 1 / 3)]
    assert [r.run_id for r in at.search_fallbacks(df).collect()] == [1]
    assert sorted((r.run_id, r.attempt_index, r.page_index, r.url) for r in at.flat_pages(df).collect() if r.attempt_index is not None) == [(1, 0, 0, "p"), (1, 0, 1, "q"), (1, 1, 0, "r")]
    assert sorted(r.run_id for r in at.flat_pages(df).collect() if r.attempt_index is None) == [4, 5]
