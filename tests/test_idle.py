import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import rows

from worklens.operators import idle

DAY = dt.datetime(2024, 1, 10)


def task(start, end, **more):
    return {"started_at": DAY + dt.timedelta(seconds=start),
            "completed_at": DAY + dt.timedelta(seconds=end), **more}


def brute(tasks):
    """The definition, row by row."""
    groups = defaultdict(list)
    for seq, t in enumerate(tasks):
        if t.get("analyst", "ana") and t["started_at"] and t["completed_at"]:
            groups[t.get("analyst", "ana")].append((t["started_at"], seq, t["completed_at"]))
    out = defaultdict(int)
    for analyst, chain in groups.items():
        chain.sort()
        for i, (_, _, end) in enumerate(chain):
            gap = chain[i + 1][0] - end if i + 1 < len(chain) else dt.timedelta(0)
            counted = dt.timedelta(0) < gap <= dt.timedelta(hours=1)
            out[analyst, end.date()] += gap // dt.timedelta(microseconds=1) if counted else 0
    return sorted((a, d, v) for (a, d), v in out.items())


@pytest.mark.parametrize("gap, counted", [(0, 0), (1, 1), (3600, 3600), (3601, 0), (-5, 0)])
def test_limits(make_log, gap, counted):
    log = make_log(task(0, 600), task(600 + gap, 900 + gap))
    assert idle.idle_time_daily(log).first().idle_s == counted


def test_gap_over_midnight_counts_on_the_earlier_day(make_log):
    log = make_log(task(86_000, 86_300), task(86_500, 87_000))
    assert rows(idle.idle_time_daily(log)) == [
        ("ana", dt.date(2024, 1, 10), 200, "00:03:20"),
        ("ana", dt.date(2024, 1, 11), 0, "00:00:00"),
    ]


def test_missing_times_and_names_are_left_out(make_log):
    log = make_log(task(0, 600), task(700, 800, analyst=None), task(1200, 1300),
                   {"started_at": None}, {"started_at": DAY, "completed_at": None})
    assert rows(idle.idle_time_daily(log), "analyst", "idle_s") == [("ana", 600)]
    assert idle.idle_time_daily(make_log()).count() == 0


def test_mean_and_total(make_log):
    log = make_log(task(0, 100), task(201, 300), task(86_400, 86_500), task(86_600, 86_700))
    assert rows(idle.idle_time_mean(log)) == [("ana", 100, "00:01:40")]
    assert rows(idle.idle_time_total(log)) == [("ana", 201, "00:03:21")]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("slice_hours", [1, 5, 24])
def test_against_brute_force(make_log, seed, slice_hours):
    rng = random.Random(seed)
    tasks = []
    for _ in range(400):
        # few starts, so that many tasks tie; ends before starts and on other days occur
        start = rng.choice([rng.randrange(0, 4 * 86_400, 1800), rng.randrange(0, 4 * 86_400)])
        end = start + rng.choice([-2000, -60, 0, 30, 600, 1500, 4000, 90_000])
        analyst = rng.choice(["hot"] * 6 + ["bob", "eve", None])
        tasks.append(task(start, end, analyst=analyst))
    got = idle.idle_by_day(make_log(*tasks), slice_hours)
    assert rows(got) == brute(tasks)


def test_before_the_epoch(make_log):
    tasks = [
        {"started_at": dt.datetime(1969, 12, 31, 22) + dt.timedelta(minutes=25 * i),
         "completed_at": dt.datetime(1969, 12, 31, 22) + dt.timedelta(minutes=25 * i + 5)}
        for i in range(12)
    ]
    assert rows(idle.idle_by_day(make_log(*tasks))) == brute(tasks)
