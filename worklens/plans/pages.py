"""The pages: named tables over one period, sharing scans.

Nothing runs until a table is used. Given a stored cube, the page reads that;
else it persists one of its own, which the first table to run fills and the
others read, until ``unpersist`` is called on the page. A lost executor costs
the recomputation of its blocks only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from worklens.config import (
    DEFAULT,
    RECENT_ANALYST_TASKS_DAYS,
    RECENT_ANALYST_TMO_DAYS,
    RECENT_DAYS,
    RECENT_PRODUCTIVITY_DAYS,
    Vocabulary,
)
from worklens.operators import idle, individual, overview, rankings
from worklens.operators.filters import filter_last_days, filter_period, is_rostered
from worklens.plans.cube import activity_cube


class Page(Mapping[str, DataFrame]):
    """Tables by name, and the persisted data behind them."""

    def __init__(self, tables: Mapping[str, DataFrame], shared: Iterable[DataFrame]):
        self._tables, self._shared = dict(tables), tuple(shared)

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def unpersist(self) -> None:
        for table in self._shared:
            table.unpersist()


def _page_cube(
    log: DataFrame, stored: DataFrame | None, first: dt.date, last: dt.date
) -> tuple[DataFrame, list[DataFrame]]:
    """The cube of the period, and what is to be unpersisted later."""
    if stored is not None:
        return filter_period(stored, first, last), []
    cube = activity_cube(log).persist(StorageLevel.MEMORY_AND_DISK)
    return cube, [cube]


def overview_page(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    excluded: Iterable[str] = (),
    stored_cube: DataFrame | None = None,
    vocabulary: Vocabulary = DEFAULT,
) -> Page:
    """Every table of the team view for one period."""
    log = filter_period(log, first, last)
    cube, shared = _page_cube(log, stored_cube, first, last)
    roster = is_rostered(excluded, vocabulary)
    productivity = overview.daily_productivity(cube)
    handled = overview.daily_registered_updated(cube, vocabulary)
    daily = overview.daily_tmo(cube, (), vocabulary)
    registered = overview.daily_tmo_registered(cube, vocabulary)
    monthly = overview.monthly_tmo_by_outcome(cube, vocabulary)
    deviations = overview.deviation_counts(log)
    tables = {
        "kpis": overview.overview_kpis(cube, vocabulary),
        "queues": overview.queue_summary(log, vocabulary),
        "groups": overview.production_by_group(cube, vocabulary),
        "modules": overview.outcome_by_module(log, vocabulary),
        "email": overview.email_group_detail(log, vocabulary),
        "deviations": deviations,
        "daily_productivity": filter_last_days(productivity, RECENT_PRODUCTIVITY_DAYS, ()),
        "daily_registered_updated": filter_last_days(handled, RECENT_DAYS, ()),
        "daily_tmo": filter_last_days(daily, RECENT_DAYS, ()),
        "daily_tmo_registered": filter_last_days(registered, RECENT_DAYS, ()),
        "monthly_tmo": monthly,
        "monthly_tmo_long": overview.monthly_tmo_long(monthly),
        "analyst_tmo": overview.analyst_tmo(cube, vocabulary).filter(roster),
        "best_by_queue_tmo": rankings.best_by_queue_tmo(cube, vocabulary),
        "best_by_queue_volume": rankings.best_by_queue_volume(cube, vocabulary),
        "rank_overall": rankings.rank_overall(cube, roster, vocabulary),
        "rankings": rankings.all_rankings(cube, roster, vocabulary),
    }
    return Page(tables, shared)


def individual_page(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    stored_cube: DataFrame | None = None,
    vocabulary: Vocabulary = DEFAULT,
) -> Page:
    """Every table of the individual view, for all analysts; filter by ``analyst`` to see one."""
    log = filter_period(log, first, last)
    cube, shared = _page_cube(log, stored_cube, first, last)
    monthly = individual.analyst_monthly_tmo(cube, vocabulary)
    daily = overview.daily_tmo(cube, ("analyst",), vocabulary)
    idle_daily = idle.idle_time_daily(log)
    tables = {
        "metrics": individual.analyst_metrics(cube, vocabulary),
        "against_team": individual.analyst_vs_team(cube, vocabulary),
        "best_day_tmo": individual.best_day_tmo(cube, vocabulary),
        "best_day_volume": individual.best_day_volume(cube, vocabulary),
        "queues": individual.analyst_queue_tmo(cube, vocabulary),
        "idle_daily": idle_daily,
        "idle_daily_recent": filter_last_days(idle_daily, RECENT_DAYS, ["analyst"]),
        "idle_mean": idle.idle_time_mean(log),
        "monthly_tmo": monthly,
        "monthly_tmo_long": overview.monthly_tmo_long(monthly, ["analyst"]),
        "daily_tmo": filter_last_days(daily, RECENT_ANALYST_TMO_DAYS, ["analyst"]),
        "daily_tasks": filter_last_days(
            individual.daily_task_count(cube), RECENT_ANALYST_TASKS_DAYS, ["analyst"]
        ),
        "queue_counts": individual.queue_counts(cube),
        "cause_counts": individual.cause_counts(log, vocabulary),
    }
    return Page(tables, shared)
