import random
from collections import defaultdict

import pytest

from tests.llm.common import SCHEMA, odd_rows, odd_table
from worklens.llm import mixing


def docs(spark):
    random.seed(8)
    rows = []
    for i in range(3000):
        source = "s0" if i % 3 == 0 else f"s{i % 7}"
        text = " ".join(["word"] * random.randint(1, 60) + random.choice([[], ["17"], ["licence"]]))
        rows.append((i, text, random.choice(["en", "en", "en", "de"]), source, 1))
    return spark.createDataFrame(rows, SCHEMA)


def shares(rows, key, value):
    out = defaultdict(float)
    for r in rows:
        out[r[key]] += r[value]
    return {k: v / sum(out.values()) for k, v in out.items()}


def test_margins_meet_their_targets(spark):
    given = {"lang": {"en": 0.5, "de": 0.5}}
    mix = mixing.Mix(keep=0.3, shares=given, sweeps=20)
    table = mixing.with_cell(docs(spark))
    cells = table.groupBy(*mixing.MARGINS).agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "tokens")
    rates = mixing.cell_rates(cells, mix).collect()
    assert sum(r.weight for r in rates) == pytest.approx(1)
    assert shares(rates, "lang", "weight") == pytest.approx({"en": 0.5, "de": 0.5}, abs=1e-6)
    for margin in ("source", "topic"):
        raw = {k: v ** mix.temper[margin] for k, v in shares(rates, margin, "tokens").items()}
        want = {k: v / sum(raw.values()) for k, v in raw.items()}
        assert shares(rates, margin, "weight") == pytest.approx(want, abs=1e-6)
    # The calibrated probabilities spend the budget exactly, cells that are full included.
    total = sum(r.tokens for r in rates)
    assert sum(r.tokens * r.p for r in rates) == pytest.approx(0.3 * total, rel=1e-6)
    assert all(0 <= r.p <= 1 for r in rates)


def test_draws_follow_the_probabilities(spark):
    rows = mixing.mixed(docs(spark)).drop("row").collect()
    kept = sum(r.tokens for r in rows if r.kept) / sum(r.tokens for r in rows)
    assert kept == pytest.approx(0.5, abs=0.05)
    again = mixing.mixed(docs(spark).repartition(5)).selectExpr("row.doc_id AS d", "kept").collect()
    first = mixing.mixed(docs(spark)).selectExpr("row.doc_id AS d", "kept").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))


def test_odd_rows(spark):
    rows = mixing.mixed(odd_table(spark)).selectExpr("row.doc_id", "tokens", "p", "topic", "source").collect()
    assert all(0 <= r.p <= 1 for r in rows)
    tokens = sorted(len((r[1] or "").encode().split()) for r in odd_rows())
    assert sorted(r.tokens for r in rows) == tokens


def test_topic_column_is_taken_if_there_is_one(spark):
    df = docs(spark).limit(20).selectExpr("*", "if(doc_id % 2 = 0, 'even', NULL) AS topic")
    assert {r.topic for r in mixing.with_cell(df).collect()} == {"even", ""}


def test_no_python_in_the_plan(spark, capsys):
    mixing.sample_to_mix(docs(spark)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
