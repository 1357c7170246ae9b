"""Sums and means, as SQL text, that work on task rows and on pre-aggregated rows alike.

``with_measures`` gives every task row the additive measures below. An
``activity_cube`` (see ``worklens.plans.cube``) holds the same measures already
summed, so an operator written with these helpers runs on either one.

    n            tasks
    timed        tasks whose duration is known
    dur_s        whole seconds of duration
    dur_us       microseconds of duration beyond the whole seconds
    with_outcome, with_status   tasks whose outcome / status is known

Two BIGINT sums in place of one keep totals exact without decimals: a single
sum of microseconds overflows after some 1.3 billion two-hour tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from worklens.config import DOUBT_LIMIT, MICROS
from worklens.functions.calendar import is_cube

MEASURES = ("n", "timed", "dur_s", "dur_us", "with_outcome", "with_status")
SUMS = ("n", "timed", "dur_s", "dur_us")


def with_measures(log: DataFrame, duration: str = "duration_us") -> DataFrame:
    if is_cube(log):
        return log
    # Columns of a log that only share a measure's name are none of ours.
    log = log.drop(*MEASURES, "over_doubt_limit")
    known = log.columns

    def present(name: str) -> str:
        return f"CAST({name} IS NOT NULL AS BIGINT)" if name in known else "0L"

    return log.selectExpr(
        "*",
        "1L AS n",
        f"{present(duration)} AS timed",
        f"{duration} div {MICROS} AS dur_s",
        f"{duration} % {MICROS} AS dur_us",
        f"{present('outcome')} AS with_outcome",
        f"{present('status')} AS with_status",
        f"coalesce({duration} > {DOUBT_LIMIT}, false) AS over_doubt_limit",
    )


def total(measure: str, when: str | None = None) -> str:
    """Sum of a measure over the rows that satisfy ``when``; 0 if there are none."""
    kept = "" if when is None else f" FILTER (WHERE {when})"
    return f"coalesce(sum({measure}){kept}, 0L)"


def totals(measures: Iterable[str] = SUMS, when: str | None = None, prefix: str = "") -> dict:
    """Name -> sum, to be combined further by ``mean_s_of`` and ``mean_us_of``."""
    return {f"{prefix}{m}": total(m, when) for m in measures}


def tasks(when: str | None = None) -> str:
    return total("n", when)


def mean_us(when: str | None = None, per: str = "timed") -> str:
    """Exact mean duration in whole microseconds; null without rows to divide by."""
    return mean_us_of(total("dur_s", when), total("dur_us", when), total(per, when))


def mean_s(when: str | None = None, per: str = "timed") -> str:
    """Exact mean duration in whole seconds; null without rows to divide by.

    ``per="timed"`` divides by the tasks with a known duration, ``per="n"`` by
    all of them, so that an unknown duration counts as zero.
    """
    return mean_s_of(total("dur_s", when), total("dur_us", when), total(per, when))


def mean_s_of(dur_s: str, dur_us: str, count: str) -> str:
    return f"(({dur_s} + {dur_us} div {MICROS}) div nullif({count}, 0L))"


def mean_us_of(dur_s: str, dur_us: str, count: str) -> str:
    c = f"nullif({count}, 0L)"
    return f"({dur_s} div {c} * {MICROS} + ({dur_s} % {c} * {MICROS} + {dur_us}) div {c})"


def or_zero(value: str) -> str:
    return f"coalesce({value}, 0L)"
