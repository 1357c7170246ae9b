"""Every registered query against its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import checks.queries
from checks.oracle import oracle_sql
from checks.queries import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{DATA}/{file}'")
    return con


def table(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([row[i] for i in order] for row in found), key=str)


def test_each_query_has_its_sql():
    assert set(queries()) == set(oracle_sql())


def test_the_entry_registers_them():
    """The corpus operators, where they are there, come on top; tests/llm holds their tests."""
    assert set(queries()) <= set(entry.queries())
    assert set(oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    got = table(df.columns, df.collect())
    answer = duck.execute(oracle_sql()[name])
    assert got == table([c[0] for c in answer.description], answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_uploads_of_many_rows_are_several_files_in_order(spark, duck, monkeypatch):
    """They are sorted and written by as many tasks; numbers and first rows stay."""
    monkeypatch.setattr(checks.queries, "UPLOAD_ROWS", 90)
    for name in ("ingest_quoted_text", "ingest_many_files", "ingest_repeated_upload"):
        test_query(spark, duck, name)
    path = checks.queries._scratch(spark, "several")
    checks.queries._upload(checks.queries._uploaded(spark, DATA).select("seq", "part", "queue"), path)
    files = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    times = [os.stat(f"{path}/{f}").st_mtime_ns for f in files]
    assert len(files) > 5 and times == sorted(set(times))
