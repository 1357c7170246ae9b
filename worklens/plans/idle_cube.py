"""Idle time from summaries that are stored with each batch.

A unit is what one batch has of an analyst's hour: the idle time within it, its first and last
start, and the end that it leaves open. Units of an analyst that lie one after another are
chained by their ends, in any grouping: a gap between two units is the next one's first start
less the open end. That covers nearly all of them, as batches are mostly of different days.
Where units of one hour overlap, or a period cuts one, that hour alone is taken from the log.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.functions.calendar import date, interval_us
from worklens.operators.idle import SLICE_HOURS, chained_slices, idle_slices
from worklens.sources.store import Snapshot, scan_beside, scan_log

_NTZ = T.TimestampNTZType()
IDLE = T.StructType(
    [
        T.StructField("analyst", T.StringType()),
        T.StructField("slice", T.LongType()),
        T.StructField("idle_us", T.LongType()),
        T.StructField("first_start", _NTZ),
        T.StructField("open_end", _NTZ),
        T.StructField("unit_first", _NTZ),
        T.StructField("unit_last", _NTZ),
        T.StructField("first_day", T.DateType()),
        T.StructField("last_day", T.DateType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("day", T.DateType()),
    ]
)


def idle_of_batches(log: DataFrame) -> DataFrame:
    """The units of a stored log: a row for each batch, analyst, slice and day of end."""
    unit = "OVER (PARTITION BY batch, analyst, slice)"
    return idle_slices(log, by=["batch"]).selectExpr(
        "analyst", "slice", f"{interval_us('idle')} AS idle_us", "first_start", "open_end",
        f"min(first_start) {unit} AS unit_first", f"max(last_start) {unit} AS unit_last",
        f"min(day) {unit} AS first_day", f"max(day) {unit} AS last_day", "batch", "day",
    )


def _marked(units: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Marks the slices whose units don't simply follow each other within the period."""
    cut = "false"
    if first is not None:
        cut += f" OR first_day < {date(first)}"
    if last is not None:
        cut += f" OR last_day > {date(last)}"
    slice_ = "PARTITION BY analyst, slice"
    # Rows of one unit are equals; units that share a start overlap.
    return units.selectExpr(
        "*", f"dense_rank() OVER ({slice_} ORDER BY unit_first, batch) AS unit"
    ).selectExpr(
        "*",
        f"max(unit_last) OVER ({slice_} ORDER BY unit RANGE BETWEEN UNBOUNDED PRECEDING AND"
        " 1 PRECEDING) AS reached",
    ).selectExpr(
        "*", f"max(({cut}) OR coalesce(unit_first <= reached, false)) OVER ({slice_}) AS again"
    )


def stored_idle(
    spark: SparkSession,
    found: Snapshot,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> DataFrame:
    """Per analyst and day of end: counted idle microseconds, equal to ``idle_by_day`` of the
    snapshot's log, cut to a period if one is given. The idle operators take it as a log.

    The log is read for the days of overlapping or cut hours only, and of segments that were
    written without summaries."""
    found = found.between(first, last)
    units = _marked(scan_beside(spark, found, "idle", IDLE, idle_of_batches), first, last)
    again = units.where("again").select("analyst", "slice", "day").distinct()
    days = {r.day.isoformat() for r in again.select("day").distinct().collect()}  # one row a day
    micros = "INTERVAL '0 00:00:00.000001' DAY TO SECOND"
    plain = units.where("NOT again").selectExpr(
        "analyst", "day", "unit_first AS start", "first_start", "open_end",
        f"idle_us * {micros} AS idle",
    )
    if days:
        part = replace(found, entries=tuple(e for e in found.entries if e.day in days))
        log = scan_log(spark, part)
        hours = again.selectExpr("analyst AS u_analyst", "slice AS u_slice").distinct()
        hour = (
            "(unix_date(to_date(started_at)) * 24L + hour(started_at))"
            f" div {SLICE_HOURS} = u_slice"
        )
        same = F.expr(f"analyst = u_analyst AND {hour}")
        slices = idle_slices(log.join(hours, same, "left_semi"))
        start = "min(first_start) OVER (PARTITION BY analyst, slice) AS start"
        plain = plain.union(
            slices.selectExpr("analyst", "day", start, "first_start", "open_end", "idle")
        )
    order = f"({interval_us(_since('start'))})"
    return chained_slices(plain.selectExpr("*", f"{order} AS place"), "place")


def _since(time: str) -> str:
    return f"({time} - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
