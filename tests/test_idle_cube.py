"""Idle time from stored summaries against that of the log, over any split into batches."""

import datetime as dt
import random

import pytest
from conftest import rows

from worklens.operators import idle, reports
from worklens.operators.filters import filter_period
from worklens.plans import cube
from worklens.plans.idle_cube import stored_idle
from worklens.sources import readers, store, writers

BEGIN = dt.datetime(2024, 1, 10, 22)


def made(make_log, seed, n=120):
    random.seed(seed)
    out = []
    for i in range(n):
        # Whole and half minutes over five hours around midnight: ties, overlaps, long gaps.
        start = BEGIN + dt.timedelta(seconds=30 * random.randint(0, 600))
        end = start + dt.timedelta(minutes=random.choice([0, 1, 5, 30, 90, 1500]))
        out.append(
            {
                "seq": i, "analyst": random.choice(["ana", "ana", "bob", None]),
                "started_at": random.choice([start] * 9 + [None]),
                "completed_at": random.choice([end] * 9 + [None]),
            }
        )
    return make_log(*out)


@pytest.mark.parametrize("seed, split", [(1, "seq % 3"), (2, "seq div 40"), (3, "hour(started_at) % 4"),
                                         (4, "day(completed_at) % 3"), (5, "0")])
@pytest.mark.parametrize("compacted", [False, True])
def test_any_split(spark, tmp_path, make_log, seed, split, compacted):
    root, log = str(tmp_path / "log"), made(make_log, seed)
    for batch in range(4):
        part = log.filter(f"coalesce({split}, 0) = {batch}")
        writers.write_task_log(part, batch, root, with_idle=batch != 2)
    if compacted:
        writers.compact_log(spark, root)
    found = store.snapshot(spark, root)
    whole = readers.scan_task_log(spark, root)
    assert rows(stored_idle(spark, found)) == rows(idle.idle_by_day(whole))
    for first, last in ((BEGIN.date(), BEGIN.date()), (dt.date(2024, 1, 11), dt.date(2024, 1, 11)),
                        (None, BEGIN.date()), (dt.date(2025, 1, 1), dt.date(2025, 1, 2))):
        cut = filter_period(whole, first or dt.date(1900, 1, 1), last)
        assert rows(stored_idle(spark, found, first, last)) == rows(idle.idle_by_day(cut))


def test_replaced_batches_are_gone(spark, tmp_path, make_log):
    root, log = str(tmp_path / "log"), made(make_log, 6)
    for batch in range(3):
        writers.write_task_log(log.filter(f"seq % 3 = {batch}"), batch, root, with_idle=True)
    writers.compact_log(spark, root)
    writers.write_task_log(log.filter("seq < 20"), 1, root, with_idle=True)
    whole = readers.scan_task_log(spark, root)
    found = store.snapshot(spark, root)
    assert any(e.hidden for e in found.entries)
    assert rows(stored_idle(spark, found)) == rows(idle.idle_by_day(whole))


def test_separate_days_read_no_log(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    for batch in range(3):
        start = dt.datetime(2024, 1, 10 + batch, 9)
        log = make_log(
            *[
                {"started_at": start + dt.timedelta(minutes=20 * i),
                 "completed_at": start + dt.timedelta(minutes=20 * i + 10)}
                for i in range(9)
            ]
        )
        writers.write_task_log(log, batch, root, with_idle=True, with_cube=True)
    found = store.snapshot(spark, root)
    days = stored_idle(spark, found)
    assert all("/idle/" in f for f in days.inputFiles())
    assert rows(days) == rows(idle.idle_by_day(readers.scan_task_log(spark, root)))
    first, last = dt.date(2024, 1, 10), dt.date(2024, 1, 11)
    log = readers.scan_task_log(spark, root)
    summed = cube.scan_stored_cube(spark, found)
    card = reports.team_card(
        log, first, last, cube=summed, idle_days=stored_idle(spark, found, first, last)
    )
    assert not any("/log/segment" in f for f in card.inputFiles())
    assert rows(card) == rows(reports.team_card(log, first, last))
    scores = reports.analyst_scorecard(log, first, last)
    assert rows(
        reports.analyst_scorecard(log, first, last, idle_days=stored_idle(spark, found, first, last))
    ) == rows(scores)


def test_an_empty_store(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    assert stored_idle(spark, store.snapshot(spark, root)).count() == 0
    writers.write_task_log(make_log(), 0, root, with_idle=True)
    assert stored_idle(spark, store.snapshot(spark, root)).count() == 0
    writers.write_task_log(make_log({"started_at": None}), 0, root, with_idle=True, with_cube=True)
    assert stored_idle(spark, store.snapshot(spark, root)).count() == 0
