"""The registered corpus queries over whole tables, against their SQL or plain Python."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_simhash import linked, plain_fingerprint
from tests.llm.common import roots
from worklens.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, database, name):
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = database.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)


def test_simhash_query(spark, database):
    rows = database.execute("SELECT doc_id, text FROM documents").fetchall()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    values = sorted(set(prints.values()))
    root = dict(zip(values, roots(len(values), linked(values))))
    least = {}
    for i, f in sorted(prints.items()):
        least.setdefault(root[f], i)
    want = {(i, f"{f:016x}", least[root[f]]) for i, f in prints.items()}
    got = queries.queries()["op4_simhash"](spark, DATA).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


#: Queries that SQL can't express, or only too slowly, and the test that holds each against brute
#: force, a library or held-out labels.
WITHOUT_SQL = {
    "op1_quality_classifier": "test_classifiers",
    "op2_byte_bpe": "test_bpe",
    "op4_simhash": "test_simhash",
    "op6_suffix_tree": "test_suffix_tree",
    "op7_toxicity": "test_classifiers",
    "op8_id_planes": "test_token_files",
    "op9_compact_windows": "test_windows",
    "op11_spelling_variants": "test_spelling",
    "op13_suffix_levels": "test_suffix_levels",
    "pipeline": "test_pipeline",
}


def test_every_query_is_held_against_something():
    import __spark_entry__ as entry

    corpus = set(queries.queries()) | {"pipeline"}
    assert corpus - set(entry.oracle_sql()) == set(WITHOUT_SQL)
    here = os.path.dirname(__file__)
    assert all(os.path.exists(f"{here}/{module}.py") for module in WITHOUT_SQL.values())


def test_every_operator_is_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = corpus_pipeline.run(spark, DATA).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.select(columns).collect()))
