"""Every operator and stage on odd rows, on an empty table, and with clashing names."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.common import odd_rows, odd_table
from worklens.llm import (
    bpe, exact, lm_suffix_tree, mixing, quality_fm, rules, simhash, token_files, toxicity_mil, windows,
)


def labels(spark, rows=None):
    made = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (4, None, None), (None, 1, 1), (7, 5, 2), (99, 1, 0)]
    return spark.createDataFrame(
        made if rows is None else rows, "doc_id long, quality int, toxic int"
    )


def quality(spark, docs):
    return quality_fm.score(docs, quality_fm.train(docs, labels(spark)))


def toxicity(spark, docs):
    return toxicity_mil.score(docs, toxicity_mil.train(docs, labels(spark)))


PER_ROW = {
    "quality": quality,
    "bpe": lambda spark, docs: bpe.encode(docs),
    "mixing": lambda spark, docs: mixing.mixed(docs).selectExpr("row.doc_id", "kept", "p"),
    "simhash": lambda spark, docs: simhash.near_duplicates(docs),
    "rules": lambda spark, docs: rules.quality_verdicts(docs),
    "suffix_tree": lambda spark, docs: lm_suffix_tree.suffix_tree_scores(docs),
    "toxicity": toxicity,
    "token_files": lambda spark, docs: token_files.written_and_read(docs),
    "exact": lambda spark, docs: exact.content_groups(docs),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(spark, name):
    found = PER_ROW[name](spark, odd_table(spark)).select("doc_id").collect()
    assert Counter(r[0] for r in found) == Counter(r[0] for r in odd_rows())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, odd_table(spark, [])).count() == 0


def test_passages_on_odd_tables(spark):
    assert windows.shared_passages(odd_table(spark, [])).count() == 0
    assert windows.shared_passages(odd_table(spark)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    docs = odd_table(spark)
    kept = stage(spark, docs, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert kept.columns == docs.columns
    assert kept.count() <= docs.count()
    assert stage(spark, odd_table(spark, []), "").count() == 0
