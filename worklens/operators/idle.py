"""Idle time: the gaps between an analyst's tasks.

The next task is the next one by start, then by batch and ``seq``. A gap counts from the
end of a task to the start of the next one if it is above zero and at most an
hour, on the day the earlier task ended.

One analyst may hold a large share of all tasks, and many tasks may share one
start, so neither an analyst nor a start is ever one window partition:

1. Tasks of one analyst with the same start are reduced before the shuffle. All
   but the last of them are followed by that same start, so their gaps are known
   on the spot; only the last one, found by ``max_by(.., place)``, is kept.
2. ``lead`` runs within short slices of time per analyst.
3. The last task of a slice is followed by the first start of the analyst's next
   slice. That lookup runs over one row per slice (and day of end), not per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from worklens.config import IDLE_LIMIT_HOURS, MICROS
from worklens.functions.calendar import interval_us
from worklens.functions.durations import hms
from worklens.functions.sql import exprs, order_of

SLICE_HOURS = 1

_NONE = "INTERVAL '0' SECOND"


def _gap(next_start: str, end: str) -> str:
    """The counted gap as an interval; zero if it does not count or there is no next task."""
    gap = f"({next_start} - {end})"
    counts = f"{gap} > {_NONE} AND {gap} <= INTERVAL '{IDLE_LIMIT_HOURS}' HOUR"
    return f"CASE WHEN {counts} THEN {gap} ELSE make_dt_interval() END"


def idle_by_day(log: DataFrame, slice_hours: int = SLICE_HOURS) -> DataFrame:
    """Per analyst and day of end: counted idle microseconds, 0 on days without a gap.

    Takes a log, or the same table made from stored summaries, which is returned as it is.
    """
    if "idle_us" in log.columns:
        return log
    return chained_slices(idle_slices(log, slice_hours))


def idle_slices(
    log: DataFrame, slice_hours: int = SLICE_HOURS, by: Iterable[str] = ()
) -> DataFrame:
    """Per analyst, slice and day of end (and the columns ``by``): the idle time within the
    slice, its first and last start, and, on the day on which its last task ended, that end."""
    own = [*by, "analyst"]
    worked = log.filter(
        "analyst IS NOT NULL AND started_at IS NOT NULL AND completed_at IS NOT NULL"
    ).selectExpr(
        *own,
        "started_at",
        f"{order_of(log.columns)} AS place",
        "completed_at AS end",
        "to_date(completed_at) AS day",
    )

    # 1. one row per analyst, start and day of end
    starts = (
        worked.groupBy(*own, "started_at", "day")
        .agg(
            *exprs(
                {
                    "inner_gaps": f"sum({_gap('started_at', 'end')})",
                    "last_place": "max(place)",
                    "last_end": "max_by(end, place)",
                }
            )
        )
        .selectExpr(
            *own,
            "day",
            "started_at",
            "last_place",
            "last_end",
            # the last of them is not followed by its own start
            f"inner_gaps - {_gap('started_at', 'last_end')} AS inner_gaps",
            "(unix_date(to_date(started_at)) * 24L + hour(started_at))"
            f" div {slice_hours} AS slice",
        )
    )

    # 2. the next start inside the slice
    chained = starts.selectExpr(
        "*",
        f"lead(started_at) OVER (PARTITION BY {', '.join(own)}, slice"
        " ORDER BY started_at, last_place)"
        " AS next_start",
    )
    return chained.groupBy(*own, "slice", "day").agg(
        *exprs(
            {
                "idle": f"sum(inner_gaps + {_gap('next_start', 'last_end')})",
                "first_start": "min(started_at)",
                "last_start": "max(started_at)",
                # set only in the row of the day on which the slice's last task ended
                "open_end": "max(IF(next_start IS NULL, last_end, NULL))",
            }
        )
    )


def chained_slices(slices: DataFrame, order: str = "slice") -> DataFrame:
    """Idle time per analyst and day from slices, which ``order`` puts one after another."""
    # 3. the first start of a later slice, for the task each slice leaves open
    closed = slices.selectExpr(
        "*",
        f"min(first_start) OVER (PARTITION BY analyst ORDER BY {order} DESC"
        " RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next_start",
    ).selectExpr("analyst", "day", f"idle + {_gap('next_start', 'open_end')} AS idle")
    days = closed.groupBy("analyst", "day").agg(*exprs({"idle": "sum(idle)"}))
    return days.selectExpr("analyst", "day", f"{interval_us('idle')} AS idle_us")


def idle_time_daily(log: DataFrame) -> DataFrame:
    """Per analyst and day: idle time."""
    seconds = f"idle_us div {MICROS}"
    return idle_by_day(log).selectExpr(
        "analyst", "day", f"{seconds} AS idle_s", f"{hms(seconds)} AS idle"
    )


def idle_time_mean(log: DataFrame) -> DataFrame:
    """Per analyst: mean idle time of the days with tasks."""
    mean = f"sum(idle_us) div (count(day) * {MICROS})"
    out = idle_by_day(log).groupBy("analyst").agg(*exprs({"idle_mean_s": mean}))
    return out.selectExpr("*", f"{hms('idle_mean_s')} AS idle_mean")


def idle_time_total(log: DataFrame) -> DataFrame:
    """Per analyst: idle time of all days."""
    total = {"idle_total_s": f"sum(idle_us) div {MICROS}"}
    out = idle_by_day(log).groupBy("analyst").agg(*exprs(total))
    return out.selectExpr("*", f"{hms('idle_total_s')} AS idle_total")
