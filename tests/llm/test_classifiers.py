import random

import numpy as np
import pytest

from tests.llm.common import SCHEMA, crc
from worklens.llm import quality_fm, toxicity_mil
from worklens.llm.training import labelled_sample


def test_pairwise_interactions_in_linear_time():
    """The sum-of-squares form equals the sum over all pairs of features."""
    rng = np.random.default_rng(0)
    model = {"w0": np.array([0.3]), "w": rng.normal(size=50), "v": rng.normal(size=(50, 4))}
    counts = np.array([3, 1, 7])
    ids, values = rng.integers(0, 50, 11), rng.normal(size=11)
    got = quality_fm.raw_scores(model, ids, values, counts)[0]
    at = 0
    for n, score in zip(counts, got):
        i, x = ids[at : at + n], values[at : at + n]
        want = 0.3 + (model["w"][i] * x).sum()
        for a in range(n):
            for b in range(a + 1, n):
                want += model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b]
        assert score == pytest.approx(want)
        at += n


def test_gradient_learns_an_interaction():
    """Two features whose product decides: a linear model can't, the machine can."""
    settings = quality_fm.FactorSettings(epochs=300, shrink=0)
    y = np.array([0.0, 1.0, 1.0, 0.0] * 50)
    ids = np.array([[0, 2], [0, 3], [1, 2], [1, 3]] * 50).ravel()
    values, counts = np.ones(len(ids)), np.full(len(y), 2)
    model = quality_fm.fit(ids, values, counts, y, settings)
    z = quality_fm.raw_scores(model, ids, values, counts)[0]
    assert ((z > 0) == (y > 0.5)).all()


def corpus(spark, n=600):
    random.seed(11)
    words = [f"word{i}" for i in range(300)]
    docs, labels, bad = [], [], {}
    for i in range(n):
        sentences = [" ".join(random.choices(words, k=8)) + "." for _ in range(random.randint(3, 8))]
        toxic, junk = int(random.random() < 0.25), int(random.random() < 0.3)
        if toxic:
            bad[i] = random.randrange(len(sentences))
            sentences[bad[i]] = sentences[bad[i]].replace(" ", f" {random.choice(['scurvy', 'knave'])} ", 1)
        text = "\n".join(sentences)
        if junk:
            text = text.replace(" ", "## ")
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1 - junk, toxic))
    return (
        spark.createDataFrame(docs, SCHEMA),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {r[0]: r for r in labels},
        bad,
    )


def test_held_out_accuracy_and_offending_sentences(spark):
    docs, labels, truth, bad = corpus(spark)
    settings = quality_fm.FactorSettings()
    rows = quality_fm.score(docs, quality_fm.train(docs, labels, settings), settings).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = np.mean([r.predicted == truth[r.doc_id][1] for r in held])
    assert right > 0.95 and all(0 <= r.score <= 1 for r in rows)
    settings = toxicity_mil.InstanceSettings()
    rows = toxicity_mil.score(docs, toxicity_mil.train(docs, labels, settings), settings).collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][2] for r in held]) > 0.95
    named = [r.offend == [bad[r.doc_id]] for r in held if r.doc_id in bad]
    assert np.mean(named) > 0.9


def test_noisy_or():
    scorer = toxicity_mil.Scorer({"weight": np.ones(8, np.float32), "bias": -2.0}, 8)
    some, none, twice, thrice = scorer.sentences([b"One two. Three! Four", None, b"aa aa.", b"aa aa aa."])
    assert len(some) == 3 and len(none) == 1
    # Distinct words of a sentence count once.
    assert twice[0] == thrice[0]


def test_only_one_label_or_none(spark):
    docs, labels, *_ = corpus(spark, 40)
    only = labels.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    scores = {round(r.score, 6) for r in quality_fm.score(docs, quality_fm.train(docs, only)).collect()}
    assert min(scores) > 0.7
    assert {r.predicted for r in toxicity_mil.score(docs, toxicity_mil.train(docs, only)).collect()} == {0}
    none = labels.where("false")
    rows = quality_fm.score(docs, quality_fm.train(docs, none)).collect()
    assert {r.score for r in rows} == {0.5}


def test_sample_is_bounded_and_never_held_out(spark):
    docs, labels, *_ = corpus(spark, 300)
    rows = labelled_sample(docs, labels, "quality", 50, 10_000).collect()
    assert len(rows) == 50 and all(crc(r.doc_id) % 4 != 2 for r in rows)
    again = labelled_sample(docs.repartition(3), labels.repartition(4), "quality", 50, 10_000).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in again}
