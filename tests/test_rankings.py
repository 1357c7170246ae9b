from dataclasses import replace

import pytest
from conftest import rows

from worklens.config import DEFAULT
from worklens.operators import rankings


@pytest.mark.parametrize(
    "analysts, bands",
    [
        (1, [1]),
        (4, [1, 2, 3, 4]),
        (5, [1, 1, 2, 2, 3]),
        (12, [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3),
        (13, [1] * 4 + [2] * 4 + [3] * 4 + [4]),
        (20, [1] * 4 + [2] * 4 + [3] * 4 + [4] * 8),
    ],
)
def test_bands(make_log, analysts, bands):
    log = make_log(*[{"analyst": f"a{i:02d}"} for i in range(analysts)])
    got = rows(rankings.rank_overall(log), "analyst", "position", "band")
    assert got == [(f"a{i:02d}", i + 1, b) for i, b in enumerate(bands)]


def test_overall_keeps_zero_totals_and_breaks_ties_by_name(make_log):
    log = make_log({"analyst": "bob"}, {"analyst": "ana"}, {"analyst": "eve", "outcome": "AUDITED"},
                   {"analyst": None})
    got = rankings.rank_overall(log).orderBy("position").collect()
    assert [(r.analyst, r.total) for r in got] == [("ana", 1), ("bob", 1), ("eve", 0)]


def test_single_rankings_filter_by_queue(make_log):
    log = make_log(
        {"queue": None}, {"queue": "PRE REG", "minutes": None}, {"queue": "OFFICIAL LETTERS"},
        {"queue": "AGENCIES"}, {"queue": "AUDIT", "outcome": "AUDITED"},
        {"queue": "DIST A", "outcome": "DISTRIBUTED"}, {"queue": "DIST", "outcome": "UPDATED"},
    )
    singles = {
        name: rows(rankings.rank_by(log, name), "total", "tmo_s", "tmo")
        for name in rankings.ranking_rules()
    }
    assert singles == {
        "updates": [(1, 1800, "00:30:00")],
        "registration": [(1, 1800, "00:30:00")],
        "pre_registration": [(1, None, "00:00:00")],
        "official_letters": [(1, 1800, "00:30:00")],
        "agencies": [(1, 1800, "00:30:00")],
        "audit": [(1, 1800, "00:30:00")],
        "distribution": [(1, 1800, "00:30:00")],
    }
    together = rankings.all_rankings(log)
    for name in singles:
        assert rows(together.filter(f"ranking = '{name}'").drop("ranking")) == rows(
            rankings.rank_by(log, name)
        )


def test_best_by_queue(make_log):
    log = make_log(
        {"analyst": "bob", "minutes": 10}, {"analyst": "ana", "minutes": 10},
        {"analyst": "eve_ter", "minutes": 1}, {"analyst": "zed", "minutes": 2},
        {"analyst": "bob", "minutes": None}, {"analyst": "bob", "queue": "DOUBT", "minutes": None},
        {"analyst": "ana", "queue": None}, {"analyst": "ana", "outcome": "AUDITED"},
    )
    words = replace(DEFAULT, best_excluded="zed")
    assert rows(rankings.best_by_queue_tmo(log, words)) == [("INCIDENT", "ana", "00:10:00", 1)]
    assert rows(rankings.best_by_queue_tmo(log)) == [("INCIDENT", "zed", "00:02:00", 1)]
    assert rows(rankings.best_by_queue_volume(log, words)) == [
        ("DOUBT", "bob", 1), ("INCIDENT", "bob", 2),
    ]
    # the volume rule leaves out every name that contains the word
    wider = replace(DEFAULT, best_excluded="bo")
    assert rows(rankings.best_by_queue_volume(log, wider)) == [("INCIDENT", "ana", 1)]


def test_most_productive(make_log):
    log = make_log({"analyst": "bob"}, {"analyst": "ana"}, {"analyst": None}, {"analyst": None})
    assert rows(rankings.most_productive(log)) == [("ana", 1)]
    assert rankings.rank_overall(make_log()).count() == 0
