"""Every query of the engine that SQL can express, against that SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from shroud import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_its_sql(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = db.execute(own.SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_without_sql_runs(spark, name):
    assert own.QUERIES[name](spark, SF).count() >= 0


def test_status_of_guarded_and_decided_files(spark):
    got = {r.file: (r.status, len(r.outputs) > 0) for r in own.status_files(spark, SF).collect()}
    assert got == {"pending.csv": ("pending", False), "decided.csv": ("decided", True)}


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_emails_are_found_before_python_sees_a_text(spark):
    """The gate keeps texts without a digit or an at sign from the Python worker; nothing is lost by it."""
    from shroud.functions.detect import find, find_pii, with_matches

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, *f) for r in docs.collect() for f in find(r.text or ""))
    assert sorted(map(tuple, find_pii(docs, "text", "doc_id").collect())) == want
    assert with_matches(docs, "text").count() == docs.count()


def test_filters_and_columns_reach_the_scan(spark, capsys):
    own.gen_date_month(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<o_orderdate:timestamp" in plan and "ReadSchema: struct<o_orderkey" not in plan
