import datetime as dt

from conftest import rows

from worklens.operators import overview


def test_kpis_of_nothing_are_zero(make_log):
    row = overview.overview_kpis(make_log()).first()
    assert (row.total, row.total_tmo_s, row.total_tmo_text) == (0, 0, "0 min 0s")


def test_kpis_count_unknown_durations_as_zero(make_log):
    log = make_log({"minutes": 10}, {"minutes": None}, {"outcome": "AUDITED", "minutes": 4},
                   {"outcome": None}, {"outcome": "UPDATED", "minutes": 2})
    row = overview.overview_kpis(log).first()
    assert (row.registered, row.updated, row.audited, row.total) == (2, 1, 1, 3)
    assert (row.registered_tmo_s, row.total_tmo_s, row.audited_tmo_s) == (300, 240, 240)


def test_queue_summary(make_log):
    log = make_log(
        # protocol 1: first task updated, the second does not count as out of scope
        {"protocol_id": "1", "queue": "AUDIT", "outcome": "UPDATED", "minutes": 4},
        {"protocol_id": "1", "queue": "AUDIT", "outcome": "WITHDRAWN", "minutes": 6},
        # missing protocols are one protocol: only the first of them counts
        {"protocol_id": None, "queue": "AUDIT", "outcome": None, "minutes": 8},
        {"protocol_id": None, "queue": "AUDIT", "outcome": None, "minutes": 10},
        # without a duration: not there at all, not even as a first task
        {"protocol_id": "2", "queue": "AUDIT", "outcome": "REGISTERED", "minutes": None},
        {"protocol_id": "2", "queue": "AUDIT", "outcome": "AUDITED", "minutes": 2},
        # handled and spread work of one queue stay apart
        {"protocol_id": "3", "queue": "DIST", "outcome": "DISTRIBUTED", "minutes": 1},
        {"protocol_id": "4", "queue": "DIST", "outcome": "REGISTERED", "minutes": 30},
        # never in the table
        {"protocol_id": "5", "queue": "Distribution", "outcome": "REGISTERED"},
        {"protocol_id": "6", "queue": None, "outcome": "REGISTERED"},
        {"protocol_id": "7", "queue": "DOUBT", "outcome": "WITHDRAWN"},
    )
    assert rows(overview.queue_summary(log)) == [
        ("AUDIT", "audit", 1, None, None, 2, "00:02:00", "00:00:00", "00:06:30"),
        ("AUDIT", "handled", 1, 0, 1, 2, "00:00:00", "00:04:00", "00:06:30"),
        ("DIST", "distribution", 1, None, None, 1, "00:01:00", "00:00:00", "00:00:00"),
        ("DIST", "handled", 1, 1, 0, 1, "00:30:00", "00:00:00", "00:00:00"),
    ]


def test_queue_without_first_tasks_has_no_scope_count(make_log):
    log = make_log({"protocol_id": "1", "queue": "DOUBT"}, {"protocol_id": "1", "queue": "AUDIT"})
    assert rows(overview.queue_summary(log), "queue", "out_of_scope") == [
        ("AUDIT", None), ("DOUBT", 0),
    ]


def test_groups(make_log):
    log = make_log(
        {"queue": " REG ROBOT"}, {"queue": "REG ROBOT"}, {"queue": None, "outcome": None},
        {"queue": "AGENCIES", "outcome": "UPDATED"}, {"queue": "OFFICIAL LETTERS"},
    )
    assert rows(overview.production_by_group(log)) == [
        ("CAPTURE", 1, 0, 0), ("EMAIL", 0, 1, 0), ("OTHER", 2, 0, 1),
    ]


def test_email_detail_keeps_a_task_type_named_like_a_queue_apart(make_log):
    log = make_log(
        {"queue": "REG EMAIL", "task_type": "AGENCIES"}, {"queue": "AGENCIES", "outcome": None},
        {"queue": "REG EMAIL", "task_type": None},
    )
    assert rows(overview.email_group_detail(log)) == [("AGENCIES", 1, 0, 0, 1),
                                                      ("AGENCIES", 1, 1, 0, 0)]


def test_modules(make_log):
    log = make_log({"module": "TAX"}, {"module": "TAX", "outcome": "UPDATED"}, {"module": None},
                   {"module": "CIVIL", "outcome": "AUDITED"})
    assert rows(overview.outcome_by_module(log)) == [("TAX", 1, 1)]


def test_days(make_log):
    day, other = dt.date(2024, 1, 10), dt.date(2024, 1, 11)
    late = {"completed_at": dt.datetime(2024, 1, 11)}
    log = make_log({"minutes": 10}, {"minutes": None}, {"outcome": None, **late},
                   {"outcome": "UPDATED", "status": "Cancelled", "minutes": 4, **late},
                   {"completed_at": None})
    assert rows(overview.daily_productivity(log)) == [(day, 2), (other, 1)]
    assert rows(overview.daily_registered_updated(log)) == [(day, 2, 0, 2), (other, 0, 1, 1)]
    assert rows(overview.daily_tmo(log)) == [(day, 600, "10 min 0s")]
    assert rows(overview.daily_tmo_registered(log)) == [(day, 300, "5 min 0s")]
    assert rows(overview.daily_tmo_closed(log), "day", "tmo_s") == [(day, 300), (other, 1020)]
    assert rows(overview.daily_tmo_closed_zero_filled(log), "day", "tmo_s") == [(other, 240)]


def test_a_day_without_any_known_duration(make_log):
    log = make_log({"minutes": None})
    assert rows(overview.daily_tmo(log), "tmo_s", "tmo_text") == [(None, "0 min")]
    assert rows(overview.daily_tmo_registered(log), "tmo_s", "tmo_text") == [(0, "0 min 0s")]


def test_months_need_an_overall_task(make_log):
    log = make_log({"minutes": 10}, {"outcome": "AUDITED", "minutes": 20},
                   {"outcome": "AUDITED", "completed_at": dt.datetime(2024, 2, 1)})
    wide = overview.monthly_tmo_by_outcome(log)
    assert rows(wide, "month", "overall_tmo_s", "audited_tmo_s", "updated_tmo") == [
        ("2024-01", 600, 1200, "00:00:00")
    ]
    assert rows(overview.monthly_tmo_long(wide), "kind", "label") == [
        ("audited", "Audited - 00:20:00"), ("overall", "Overall - 00:10:00"),
        ("registered", "Registered - 00:10:00"), ("updated", "Updated - 00:00:00"),
    ]
    assert rows(overview.monthly_tmo(log)) == [("2024-01", 10.0, "10 min 0s")]


def test_analyst_tmo(make_log):
    log = make_log(
        {"minutes": 10}, {"minutes": None}, {"minutes": 50, "status": "Open"},
        {"minutes": 90, "queue": "DOUBT"}, {"analyst": "bob", "outcome": "UPDATED"},
        {"analyst": None},
    )
    assert rows(overview.analyst_tmo(log)) == [("ana", 300, "00:05:00"), ("bob", None, "00:00:00")]


def test_deviations(make_log):
    log = make_log(*[{"deviations": d} for d in
                     ("a, b", "b ,c", "a,,b", None, "", "NO deviation")])
    assert rows(overview.deviation_counts(log)) == [
        ("", 2), ("NO deviation", 1), ("a", 2), ("b", 3), ("c", 1),
    ]
    assert overview.deviation_counts_real(log).count() == 4
    assert rows(overview.top_deviation(log)) == [("b", 3)]


def test_sums_beyond_a_single_bigint_of_microseconds(spark, make_log):
    """Two-hour tasks whose microseconds add up to more than 2**63."""
    from worklens.functions.measures import MEASURES

    cube = spark.createDataFrame(
        [(dt.date(2024, 1, 10), "ana", "q", "REGISTERED", "Finished", False,
          2_000_000_000, 2_000_000_000, 2_000_000_000 * 7199, 2_000_000_000 * 999_999,
          2_000_000_000, 2_000_000_000)],
        "day date, analyst string, queue string, outcome string, status string,"
        " over_doubt_limit boolean, " + ", ".join(f"{m} bigint" for m in MEASURES),
    )
    row = overview.overview_kpis(cube).first()
    assert (row.total, row.total_tmo_s) == (2_000_000_000, 7199)
