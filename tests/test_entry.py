"""The contract: the entry runs, queries with SQL agree with it at the smallest size, plans are as meant."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry
from check_oracle import plain
from vacantia.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_agree_with_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert mine == sorted((tuple(plain(x) for x in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_queries_need(spark):
    p = plan(entry.queries()["source_job_counts"](spark, SF))
    assert "ReadSchema: struct<source:string,company_id:bigint>" in p
    p = plan(entry.queries()["green_channels"](spark, SF))
    assert "EqualTo(decision,green)" in p
    assert "python" not in plan(entry.queries()["p7_found"](spark, SF)).lower()
