import datetime as dt

from conftest import rows

from worklens.operators import individual

TEN, ELEVEN = dt.date(2024, 1, 10), dt.date(2024, 1, 11)
NEXT_DAY = {"completed_at": dt.datetime(2024, 1, 11, 9)}


def test_metrics(make_log):
    log = make_log(
        {"minutes": 10}, {"minutes": None}, {"minutes": 20, **NEXT_DAY},
        {"queue": "Unknown"}, {"queue": None, "outcome": "UPDATED", "minutes": 4},
        {"queue": "DOUBT", "minutes": 61}, {"queue": "DOUBT", "minutes": 60},
        {"outcome": "AUDITED"}, {"analyst": "bob", "outcome": "AUDITED"}, {"analyst": None},
    )
    assert rows(individual.analyst_metrics(log)) == [
        # registered: 10 + unknown + 20 + 60 minutes over 4 tasks on 2 days
        ("ana", 4, 1, 0, 5, 94 * 60 // 5, 90 * 60 // 4, 240, 2, 2),
        ("bob", 0, 0, 0, 0, 0, 0, 0, 0, 0),
    ]


def test_against_team(make_log):
    log = make_log({"minutes": 10}, {"analyst": "bob", "minutes": 20},
                   {"analyst": None, "minutes": 30}, {"analyst": "bob", "minutes": None})
    # the team mean is over known durations, also those of unknown analysts
    assert rows(individual.analyst_vs_team(log)) == [
        ("ana", 600, 1200, False, 0, None, False), ("bob", 600, 1200, False, 0, None, False),
    ]
    log = make_log({"minutes": 10}, {"analyst": "bob", "minutes": 20})
    assert rows(individual.analyst_vs_team(log), "analyst", "registered_over_team") == [
        ("ana", False), ("bob", True),
    ]
    assert individual.team_tmo(make_log()).first().overall_tmo_s is None


def test_best_days(make_log):
    log = make_log({"minutes": 10}, {"minutes": 10, **NEXT_DAY}, {"minutes": None},
                   {"analyst": "bob", "minutes": None}, {"outcome": "UPDATED", "minutes": 1})
    assert rows(individual.best_day_tmo(log)) == [("ana", TEN, 600, "10 min 0s")]
    assert rows(individual.best_day_volume(log)) == [("ana", TEN, 2), ("bob", TEN, 1)]


def test_queues_of_an_analyst(make_log):
    log = make_log(
        {"queue": "AUDIT", "outcome": "AUDITED", "minutes": 2}, {"queue": "AUDIT", "minutes": 4},
        {"queue": "DIST", "outcome": "DISTRIBUTED", "minutes": None}, {"queue": None},
        {"queue": "DOUBT", "outcome": None},
    )
    zero = "00:00:00"
    assert rows(individual.analyst_queue_tmo(log)) == [
        ("ana", "AUDIT", "audit", 1, zero, zero, "00:02:00", zero),
        ("ana", "AUDIT", "handled", 1, "00:04:00", zero, zero, zero),
        ("ana", "DIST", "distribution", 1, zero, zero, zero, zero),
    ]
    assert rows(individual.queue_tmo_finished(log), "queue", "tasks", "tmo_text") == [
        ("AUDIT", 2, "3 min 0s"), ("DIST", 1, "0 min"), ("DOUBT", 1, "30 min 0s"),
    ]


def test_months_include_audits_and_fill_zero(make_log):
    log = make_log({"outcome": "AUDITED", "minutes": 2}, {"analyst": "bob", "outcome": None})
    assert rows(individual.analyst_monthly_tmo(log), "analyst", "month", "overall_tmo_s",
                "registered_tmo_s", "audited_tmo") == [("ana", "2024-01", 120, 0, "00:02:00")]


def test_counts(make_log):
    log = make_log({"cause": "c"}, {"cause": None}, {"cause": "c", "outcome": "UPDATED"},
                   {"queue": None, "analyst": "bob", **NEXT_DAY}, {"analyst": None})
    assert rows(individual.daily_task_count(log)) == [("ana", TEN, 3), ("bob", ELEVEN, 1)]
    assert rows(individual.queue_counts(log)) == [("ana", "INCIDENT", 3)]
    assert rows(individual.cause_counts(log)) == [("ana", "c", 1)]


def test_portfolios(make_log):
    minute = 60_000_000
    log = make_log(
        {"portfolio": "FAST", "portfolio_status": "CLOSED", "analysis_us": 2 * minute},
        {"portfolio": "FAST", "portfolio_status": "IN_PROGRESS", "analysis_us": 2 * minute + 1},
        {"portfolio": "FAST", "portfolio_status": "OTHER", "analysis_us": None},
        {"portfolio": None, "portfolio_status": "CLOSED", "analysis_us": 5 * minute + 1},
        {"portfolio": "SLOW", "portfolio_status": "RECLASSIFIED", "analysis_us": 5 * minute},
        {"portfolio": "FAST", "protocol_id": None, "analysis_us": 9 * minute},
        {"portfolio": "SLOW", "protocol_id": "1,234.0", "analysis_us": 6 * minute + 5_000_000},
    )
    assert rows(individual.portfolio_status_counts(log)) == [
        ("ana", "FAST", 1, 0, 1, 120, "2 min 0s"), ("ana", "SLOW", 0, 1, 0, 300, "5 min 0s"),
    ]
    assert rows(individual.portfolio_tmo(log)) == [("ana", "FAST", 2, 120), ("ana", "SLOW", 1, 300)]
    assert rows(individual.points_of_attention(log)) == [
        ("1001", "FAST", "2:00"), ("1003", None, "5:00"), ("1234", "SLOW", "6:05"),
    ]
