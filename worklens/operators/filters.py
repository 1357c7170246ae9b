"""Filters and the analyst roster."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.config import DEFAULT, DOUBT_LIMIT, Vocabulary
from worklens.functions.calendar import date, day_of, month_of
from worklens.functions.sql import among, text
from worklens.schema import ROSTER

Roster = DataFrame | Column | Iterable[str] | None


def in_period(log: DataFrame, first: dt.date, last: dt.date) -> str:
    """Completion day in [first, last]; written on what the storage can prune by."""
    if (name := day_of(log)) in log.columns:
        return f"({name} BETWEEN {date(first)} AND {date(last)})"
    after = last + dt.timedelta(days=1)
    return (
        f"(completed_at >= TIMESTAMP_NTZ '{first.isoformat()}'"
        f" AND completed_at < TIMESTAMP_NTZ '{after.isoformat()}')"
    )


def filter_period(log: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Keep tasks completed from ``first`` to ``last``, both included."""
    return log.filter(in_period(log, first, last))


def filter_last_days(df: DataFrame, days: int, by: Sequence[str] | None = None) -> DataFrame:
    """Keep the last ``days`` days before the latest day found in the data, inclusive.

    For a log the latest day is looked up first, by a scan of that column alone.
    ``by`` says that ``df`` is a daily table, with one row per day and ``by`` key
    (none for ``()``), each key with its own latest day; it is computed once.
    """
    day = day_of(df)
    if by is None:
        latest = df.selectExpr(f"max({day})").scalar()
        return df.filter(F.expr(day) >= F.date_sub(latest, days))
    keys = f"PARTITION BY {', '.join(by)}" if by else ""
    return (
        df.selectExpr("*", f"max({day}) OVER ({keys}) AS _latest")
        .filter(f"{day} >= date_sub(_latest, {days})")
        .drop("_latest")
    )


def filter_months(df: DataFrame, months: Iterable[str] | None = None) -> DataFrame:
    """Keep the chosen ``yyyy-MM`` months; all of them by default."""
    if months is None:
        return df
    if "month" in df.columns and "completed_at" not in df.columns:
        return df.filter(among("month", months))
    chosen = ", ".join(f"DATE '{m}-01'" for m in months)
    return df.filter(f"{month_of(df)} IN ({chosen})" if chosen else "false")


def is_rostered(excluded: Iterable[str] = (), vocabulary: Vocabulary = DEFAULT) -> Column:
    """The default selection as a row predicate: no scan of the log to find the names."""
    return F.expr(
        f"analyst IS NOT NULL AND NOT contains(analyst, {text(vocabulary.external_marker)})"
        f" AND NOT {among('analyst', excluded)}"
    )


def default_roster(
    log: DataFrame, excluded: Iterable[str] = (), vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Distinct analysts, without external ones and without the excluded names."""
    return log.filter(is_rostered(excluded, vocabulary)).select("analyst").distinct()


def filter_analysts(log: DataFrame, roster: Roster = None) -> DataFrame:
    """Keep the selected analysts: names, a predicate, or a table of names.

    A table is semi-joined without a hint: Spark broadcasts it if it is small
    enough and shuffles otherwise.
    """
    if roster is None:
        return log.filter("analyst IS NOT NULL")
    if isinstance(roster, Column):
        return log.filter(roster)
    if isinstance(roster, DataFrame):
        return log.join(roster.select("analyst"), "analyst", "left_semi")
    return log.filter(among("analyst", roster))


def roster_table(spark: SparkSession, log: DataFrame, roster: Roster) -> DataFrame:
    """The selected analysts as a table of distinct names."""
    if isinstance(roster, DataFrame):
        return roster.select("analyst").distinct()
    if roster is None or isinstance(roster, Column):
        return filter_analysts(log, roster).select("analyst").distinct()
    return spark.createDataFrame([(name,) for name in dict.fromkeys(roster)], ROSTER)


def is_doubt_outlier(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> str:
    """In the doubt queue for over an hour; never null."""
    over = (
        "over_doubt_limit"
        if "over_doubt_limit" in log.columns
        else f"coalesce(duration_us > {DOUBT_LIMIT}, false)"
    )
    return f"(queue <=> {text(vocabulary.doubt_queue)} AND {over})"


def drop_doubt_outliers(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    return log.filter(f"NOT {is_doubt_outlier(log, vocabulary)}")
