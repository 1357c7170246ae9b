import datetime as dt

from conftest import rows

from worklens.operators import reports
from worklens.plans.cube import activity_cube

FIRST, LAST = dt.date(2024, 1, 10), dt.date(2024, 1, 31)
OUTSIDE = {"completed_at": dt.datetime(2024, 2, 1)}


def test_period_summary(make_log):
    log = make_log({"minutes": 10}, {"minutes": None, "outcome": "DISTRIBUTED"}, OUTSIDE,
                   {"analyst": "bob", "outcome": "AUDITED"})
    got = reports.period_summary(log, FIRST, LAST, ["ana", "bob", "zoe"])
    assert rows(got) == [
        ("ana", 600, "00:10:00", 2, FIRST, LAST), ("bob", None, "00:00:00", 0, FIRST, LAST),
        ("zoe", None, "00:00:00", 0, FIRST, LAST),
    ]
    only = reports.period_summary(log, FIRST, LAST, ["ana"], registered_only=True)
    assert rows(only, "tasks") == [(1,)]
    assert reports.period_summary(log, FIRST, LAST).count() == 2


def test_bands_around_the_unweighted_mean(spark):
    summary = spark.createDataFrame(
        [("a", 89), ("b", 90), ("c", 110), ("d", 111), ("e", None)], "analyst string, tmo_s bigint"
    )
    got = reports.period_summary_band(summary)
    assert rows(got, "analyst", "band") == [
        ("a", "green"), ("b", "yellow"), ("c", "yellow"), ("d", "red"), ("e", None),
    ]


def test_registered_and_updated(make_log):
    log = make_log({"minutes": 10}, {"minutes": 3, "outcome": "UPDATED"}, OUTSIDE)
    assert rows(reports.period_registered_updated(log, FIRST, LAST, ["ana", "zoe"])) == [
        ("ana", "0:10:00", 1, "0:03:00", 1), ("zoe", "00:00:00", 0, "00:00:00", 0),
    ]
    assert rows(reports.analyst_daily_detail(log, FIRST, LAST, ["ana"])) == [
        ("ana", FIRST, "00:10:00", 1)
    ]
    log = make_log({"cause": "x"}, {"cause": None}, {"cause": "x", **OUTSIDE})
    assert rows(reports.cause_by_analyst(log, FIRST, LAST)) == [("ana", "x", 1)]


def test_full_summary(make_log):
    start = dt.datetime(2024, 1, 10, 9)
    log = make_log(
        {"minutes": 10, "started_at": start, "completed_at": start + dt.timedelta(minutes=5)},
        {"outcome": "AUDITED", "started_at": start + dt.timedelta(minutes=8)},
    )
    assert rows(reports.period_full_summary(log, FIRST, LAST, ["ana", "zoe"])) == [
        ("ana", "0:10:00", "0:10:00", 1, 2, "0:03:00"),
        ("zoe", "00:00:00", "00:00:00", 0, 0, "0:00:00"),
    ]


def test_overlapping_periods_are_judged_apart(make_log):
    log = make_log({"minutes": 10}, {"minutes": 20, **OUTSIDE}, {"analyst": "bob", **OUTSIDE},
                   {"analyst": "eve", "completed_at": dt.datetime(2023, 1, 1)}, {"analyst": None})
    both = (dt.date(2024, 1, 1), dt.date(2024, 2, 28))
    got = reports.period_comparison(log, (FIRST, LAST), both)
    assert rows(got, "analyst", "registered_before_tmo", "registered_after_tmo",
                "registered_after_min") == [
        ("ana", "00:10:00", "00:15:00", 15), ("bob", "00:00:00", "00:30:00", 30),
    ]


def test_registration_report(make_log):
    log = make_log({"minutes": 10}, {"analyst": "bob", "minutes": None},
                   {"analyst": None, "minutes": 20}, {"outcome": "UPDATED"})
    assert rows(reports.registration_report(log, FIRST, LAST)) == [
        ("ana", "00:10:00", 10, 1, "2024-01", "00:15:00"),
        ("bob", "00:00:00", 0, 1, "2024-01", "00:15:00"),
    ]


def test_scorecard(make_log):
    start = dt.datetime(2024, 1, 10, 9)
    log = make_log(
        {"minutes": 10, "started_at": start, "completed_at": start + dt.timedelta(minutes=5)},
        {"minutes": 20, "started_at": start + dt.timedelta(minutes=8), "queue": None},
        {"analyst": "bob", "outcome": "AUDITED", "queue": "AUDIT"},
        {"analyst": "bob", "outcome": "AUDITED", "queue": "DOUBT"},
        {"analyst": "eve", "minutes": None},
    )
    assert rows(reports.analyst_scorecard(log, FIRST, LAST)) == [
        ("ana", "00:15:00", "N/A", "00:03:00", "INCIDENT", "00:10:00"),
        ("bob", "N/A", "N/A", "N/A", None, None),
        ("eve", "N/A", "N/A", "N/A", "INCIDENT", "N/A"),
    ]


def test_team_card_from_log_or_cube(make_log):
    log = make_log({"minutes": 10}, {"minutes": 20}, {"analyst": "bob"},
                   {"outcome": "UPDATED", "minutes": 4}, OUTSIDE)
    card = reports.team_card(log, FIRST, LAST, top=1)
    assert rows(card) == [
        ("audited_tmo_s", None, "00:00:00", None), ("idle_mean_s", None, "00:00:00", None),
        ("peak_day", None, "2024-01-10", 3), ("registered_tmo_s", None, "00:20:00", 1200),
        ("top_registrant", 1, "ana", 2), ("updated_tmo_s", None, "00:04:00", 240),
    ]
    assert rows(reports.team_card(log, FIRST, LAST, 1, cube=activity_cube(log))) == rows(card)


def test_questions(make_log):
    log = make_log({"minutes": 10}, {"analyst": None, "minutes": 20})
    assert rows(reports.data_question_aggregates(log)) == [
        (None, True, 900, "00:15:00", 2), ("ana", False, 600, "00:10:00", 1),
    ]
