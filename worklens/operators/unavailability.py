"""Unavailability within working hours."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from worklens.config import MICROS, WORKDAY_END_HOUR, WORKDAY_START_HOUR
from worklens.functions.calendar import date, interval_us
from worklens.functions.durations import hours_minutes
from worklens.functions.sql import exprs


def _clipped(intervals: DataFrame) -> DataFrame:
    """Start not before the opening of its day, end not after the closing of its own day."""

    def at(name: str, hour: int) -> str:
        return f"CAST(to_date({name}) AS TIMESTAMP_NTZ) + INTERVAL '{hour}' HOUR"

    return (
        intervals.filter("start_at IS NOT NULL AND end_at IS NOT NULL")
        .selectExpr(
            "to_date(start_at) AS day",
            f"greatest(start_at, {at('start_at', WORKDAY_START_HOUR)}) AS start_at",
            f"least(end_at, {at('end_at', WORKDAY_END_HOUR)}) AS end_at",
        )
        # an interval wholly outside the working hours has no length
        .selectExpr("*", f"greatest({interval_us('(end_at - start_at)')}, 0L) AS length_us")
    )


def unavailability_daily(intervals: DataFrame) -> DataFrame:
    """Each interval clipped to the working hours, with its whole minutes."""
    return _clipped(intervals).selectExpr(
        "day", "start_at", "end_at", f"length_us div {60 * MICROS} AS minutes"
    )


def unavailability_share(intervals: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Time unavailable and time worked in a period; overlaps count twice, worked is at least 0."""
    days = (last - first).days + 1
    available = (WORKDAY_END_HOUR - WORKDAY_START_HOUR) * days * 3600
    inside = _clipped(intervals).filter(f"day BETWEEN {date(first)} AND {date(last)}")
    return (
        inside.selectExpr(f"coalesce(sum(length_us) div {MICROS}, 0L) AS unavailable_s")
        .selectExpr("*", f"greatest({available}L - unavailable_s, 0L) AS worked_s")
        .selectExpr(
            "*",
            f"{hours_minutes('unavailable_s')} AS unavailable",
            f"{hours_minutes('worked_s')} AS worked",
        )
    )


def unavailability_covered(intervals: DataFrame) -> DataFrame:
    """Per day: the seconds that intervals cover within the working hours, each moment once, and
    beside them the present ``unavailable_s``, booked on the day of the start with overlaps
    counted twice. An interval over several days covers the working hours of each of them.
    """
    known = intervals.filter("start_at < end_at")
    days = "explode(sequence(to_date(start_at), to_date(end_at)))"
    hours = f"explode(sequence({WORKDAY_START_HOUR}, {WORKDAY_END_HOUR - 1}))"
    opens = "CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, hour)"
    # Pieces of an hour at most: neither a day nor an hour with very many intervals is one
    # large group, as equal starts are reduced before the shuffle.
    pieces = (
        known.selectExpr("*", f"{days} AS day")
        .selectExpr("*", f"{hours} AS hour")
        .selectExpr(
            "day", "hour", f"greatest(start_at, {opens}) AS start_at",
            f"least(end_at, {opens} + INTERVAL '1' HOUR) AS end_at",
        )
        .filter("start_at < end_at")
        .groupBy("day", "hour", "start_at")
        .agg(*exprs({"end_at": "max(end_at)"}))
    )
    before = (
        "max(end_at) OVER (PARTITION BY day, hour ORDER BY start_at"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    new = pieces.selectExpr(
        "day", f"end_at - greatest(start_at, coalesce({before}, start_at)) AS new"
    )
    covered = new.filter("new > INTERVAL '0' SECOND").selectExpr(
        "day", f"{interval_us('new')} AS covered_us", "0L AS length_us"
    )
    present = _clipped(intervals).selectExpr("day", "0L AS covered_us", "length_us")
    sums = {f"{n}_s": f"sum({c}) div {MICROS}" for n, c in
            (("covered", "covered_us"), ("unavailable", "length_us"))}
    return covered.union(present).groupBy("day").agg(*exprs(sums))
