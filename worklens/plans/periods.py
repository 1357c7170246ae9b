"""Sums over many periods from one scan: running totals, and a period as a difference of two.

The running totals of a key hold on from a day with tasks to the day before the next one. A
period is what stands at its last day less what stands at the day before its first, so any
number of overlapping periods costs two lookups a key, not a scan each. Days are looked up
within spans of a fixed number of days, so that the lookup is a join on equal keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from worklens.config import DEFAULT, Vocabulary
from worklens.functions.calendar import day_of
from worklens.functions.measures import mean_s_of, totals, with_measures
from worklens.functions.sql import among, equals, exprs

#: Days of a span.
SPAN = 32


def running_totals(log: DataFrame, sums: Mapping[str, str], keys: Iterable[str]) -> DataFrame:
    """Per key and day with tasks: the sums of all days up to it, and the key's next day with
    tasks (``until``). Takes a log or a cube; rows without a day or a key are left out."""
    keys = list(keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in [*keys, "on_day"])
    days = (
        with_measures(log)
        .selectExpr("*", f"{day_of(log)} AS on_day")
        .where(known)
        .groupBy(*keys, "on_day")
        .agg(*exprs(sums))
    )
    # one row per key and day
    by_key = f"PARTITION BY {', '.join(keys)}" if keys else ""
    upto = f"OVER ({by_key} ORDER BY on_day ROWS UNBOUNDED PRECEDING)"
    return days.selectExpr(
        *keys, "on_day", *[f"sum({s}) {upto} AS {s}" for s in sums],
        f"lead(on_day) OVER ({by_key} ORDER BY on_day) AS until",
    )


def sums_over_periods(
    log: DataFrame, periods: DataFrame, sums: Mapping[str, str], keys: Iterable[str]
) -> DataFrame:
    """The columns of ``periods``, the keys, and the sums over each period, for every period
    and key with a task in or before it.

    ``periods`` has ``first_day`` and ``last_day``, both inclusive; a null leaves that side
    open, a last day before the first gives no rows. Periods may overlap and repeat. ``sums``
    are aggregates that add up over days.
    """
    keys, own = list(keys), periods.columns
    span = f"(unix_date({{0}}) div {SPAN})"
    # Two borders a period: the running totals at its last day, less those before its first.
    borders = (
        periods.where("coalesce(first_day <= last_day, true)")
        .selectExpr("struct(*) AS period", "monotonically_increasing_id() AS period_no")
        .selectExpr(
            "period", "period_no",
            "explode(array(struct(1L AS sign, coalesce(period.last_day, DATE '9999-12-31') AS day),"
            " struct(-1L AS sign, date_sub(period.first_day, 1) AS day))) AS border",
        )
        .selectExpr("period", "period_no", "border.sign AS sign", "border.day AS day")
        .where("day IS NOT NULL")
    )
    running = running_totals(log, sums, keys)
    # No border lies beyond the last one; a key's last totals hold up to it.
    end = borders.selectExpr("coalesce(max(day), DATE '1970-01-01') AS end_day")
    spans = (
        running.crossJoin(end)  # one row
        .where("on_day <= end_day")
        .selectExpr("*", "coalesce(date_sub(until, 1), end_day) AS to_day")
    )
    # Open ends are looked up at the last day of the log, so no span lies far from its days.
    last = running.selectExpr("max(on_day) AS log_end")
    shown = f"explode(sequence({span.format('on_day')}, {span.format('least(to_day, log_end)')}))"
    held = (
        spans.crossJoin(last)  # one row
        .selectExpr("*", f"{shown} AS span")
        .drop("until", "end_day", "log_end")
    )
    asked = borders.crossJoin(last).selectExpr(
        "period", "period_no", "sign", "least(day, log_end) AS day",
        f"{span.format('least(day, log_end)')} AS span",
    )
    found = held.join(asked, "span").where("day BETWEEN on_day AND to_day")
    return (
        found.groupBy("period_no", "period", *keys)
        .agg(*exprs({s: f"sum(sign * {s})" for s in sums}))
        .selectExpr(*[f"period.`{c}` AS `{c}`" for c in own], *keys, *sums)
    )


def many_periods(
    log: DataFrame, periods: DataFrame, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Per period and analyst with handled tasks in it: mean known duration and tasks,
    registered and updated; what ``period_registered_updated`` counts for one period."""
    sums = {}
    for name in ("registered", "updated"):
        sums |= totals(when=equals("outcome", getattr(vocabulary, name)), prefix=f"{name}_")
    handled = with_measures(log).where(among("outcome", vocabulary.handled))
    figures = sums_over_periods(handled, periods, sums, ["analyst"])
    out = []
    for name in ("registered", "updated"):
        mean = mean_s_of(*[f"{name}_{m}" for m in ("dur_s", "dur_us", "timed")])
        out += [f"{mean} AS {name}_tmo_s", f"{name}_n AS {name}"]
    return figures.where("registered_n + updated_n > 0").selectExpr(
        *[f"`{c}`" for c in periods.columns], "analyst", *out
    )
