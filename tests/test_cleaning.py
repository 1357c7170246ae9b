import datetime as dt

import pytest
from conftest import MINUTE, rows
from pyspark.sql import functions as F

from worklens.config import DEFAULT, portuguese_vocabulary
from worklens.operators import cleaning
from worklens.schema import PORTUGUESE_HEADERS


@pytest.mark.parametrize(
    "outcome, minutes, after",
    [
        ("REGISTERED", 18 + 59 / 60, 20),
        ("REGISTERED", 19, 19),
        ("REGISTERED", 120, 120),
        ("REGISTERED", 121, 120),
        ("UPDATED", 2 + 59 / 60, 3),
        ("UPDATED", 3, 3),
        ("UPDATED", 15, 15),
        ("UPDATED", 15 + 1 / 60, 15),
        ("UPDATED", 120, 15),
        ("UPDATED", 120 + 1 / 60, 120),  # the two-hour ceiling comes last and wins
        ("AUDITED", 1, 1),
        ("AUDITED", 500, 120),
        (None, 1, 1),
        (None, 500, 120),
        ("REGISTERED", None, None),
    ],
)
def test_clamp(make_log, outcome, minutes, after):
    log = make_log({"outcome": outcome, "minutes": minutes})
    got = cleaning.clamp_durations(log).first().duration_us
    assert got == (None if after is None else after * MINUTE)


def test_clamp_is_at_most_two_hours_and_logged(make_log):
    log = make_log(*[{"outcome": o, "minutes": m} for o in ("REGISTERED", "UPDATED", None)
                     for m in (None, 0, 2, 3, 10, 15, 16, 19, 119, 120, 130, 1000)])
    after = cleaning.clamp_durations(log)
    assert after.filter(F.col("duration_us") > 120 * MINUTE).count() == 0
    changed = log.alias("a").join(after.alias("b"), "seq").filter("a.duration_us <> b.duration_us")
    assert cleaning.duration_adjustments(log).count() == changed.count() == 18


def test_clamp_needs_both_columns(make_log):
    log = make_log({"minutes": 1}).drop("outcome")
    assert cleaning.clamp_durations(log).first().duration_us == MINUTE


def test_robot_and_unassigned(make_log):
    log = make_log({"analyst": "ROBOT_hub"}, {"analyst": None}, {"analyst": "ana"})
    assert rows(cleaning.exclude_robot_and_unassigned(log), "analyst") == [("ana",)]


def test_drop_listed_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` id nip ` int, `M.o.` int, seq int")
    assert cleaning.drop_listed_columns(df).columns == ["seq"]


def test_rename_headers_merges_the_two_protocol_columns(spark):
    df = spark.createDataFrame(
        [(None, "7", "x"), ("8", None, "y")],
        "`NÚMERO DO PROTOCOLO` string, Protocolo string, FILA string",
    )
    got = cleaning.rename_headers(df, PORTUGUESE_HEADERS)
    assert rows(got, "protocol_id", "queue") == [("7", "x"), ("8", "y")]


def test_standardise(spark):
    raw = spark.createDataFrame(
        [("1", "00:10:00", "05/01/2024 10:00:00"), ("2", "soon", "32/01/2024 10:00:00")],
        "protocol_id string, duration string, completed_at string",
    )
    got = cleaning.standardise_task_log(raw.withColumn("x_note", F.lit("kept")))
    assert rows(got, "protocol_id", "duration_us", "completed_at", "completed_date",
                "completed_month", "queue", "justification", "x_note") == [
        ("1", 10 * MINUTE, dt.datetime(2024, 1, 5, 10), dt.date(2024, 1, 5), "2024-01", None, "",
         "kept"),
        ("2", None, None, None, None, None, "", "kept"),
    ]


def test_append_keeps_columns_of_both(spark):
    a = spark.createDataFrame([(1, "x")], "seq int, a string")
    b = spark.createDataFrame([(2, "y")], "seq int, b string")
    assert rows(cleaning.append_batch(a, b)) == [(1, "x", None), (2, None, "y")]


def test_one_batch_or_two_give_the_same(make_log):
    log = make_log(*[{"minutes": m, "analyst": a} for m in (1, 18, 19, 130, None)
                     for a in ("ana", None, "Robot_Hub")])
    split = F.col("seq") < 7
    whole = cleaning.clean_batch(log)
    parts = cleaning.append_batch(
        cleaning.clean_batch(log.filter(split)), cleaning.clean_batch(log.filter(~split))
    )
    assert rows(whole) == rows(parts)


def test_portuguese_words_carry_the_tenant():
    words = portuguese_vocabulary("ACME", fast_portfolio="X")
    assert "DISTRIBUIÇÃO - ACME + JV" in words.distribution_queues
    assert "Nº LB (ACME - CÍVEL)" in words.dropped_columns
    assert words.robot_user == "robohub_acme"
    assert DEFAULT.registered == "REGISTERED"


def test_empty_log(make_log):
    assert cleaning.clean_batch(make_log()).count() == 0
