"""Day and month keys, and timestamps read from text, as SQL text.

Timestamps are without time zone throughout, so nothing here may pass through
a zoned timestamp: a local hour skipped by daylight saving would move.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from worklens.config import MICROS
from worklens.functions.text import shape

# The text forms dd/MM/yyyy HH:mm:ss and yyyy-MM-dd HH:mm.
_TASK_TIME = (
    "'^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$'"
)
_INTERVAL_TIME = "'^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2})$'"


def parse_task_time(text: str) -> str:
    """``dd/MM/yyyy HH:mm:ss``; null if the text or the date is not valid."""
    plain = (
        f"concat(substring({text}, 7, 4), '-', substring({text}, 4, 2), '-',"
        f" substring({text}, 1, 2), substring({text}, 11))"
    )
    other = f"regexp_replace({text}, {_TASK_TIME}, '$3-$2-$1 $4:$5:$6')"
    return (
        f"CASE WHEN {shape(text)} = '00/00/0000 00:00:00'"
        f" THEN try_cast({plain} AS TIMESTAMP_NTZ)"
        f" WHEN {text} RLIKE {_TASK_TIME} THEN try_cast({other} AS TIMESTAMP_NTZ) END"
    )


def parse_interval_time(text: str) -> str:
    """``yyyy-MM-dd HH:mm``; null if the text or the date is not valid."""
    t = f"trim({text})"
    return (
        f"CASE WHEN {t} RLIKE {_INTERVAL_TIME}"
        f" THEN try_cast(concat({t}, ':00') AS TIMESTAMP_NTZ) END"
    )


def time_of_nanos(value: str) -> str:
    """Whole nanoseconds since 1970 as a timestamp, cut to microseconds."""
    micros = f"floor({value} / 1000)"
    return (
        f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(CAST({micros} div 86400000000 AS INT),"
        f" 0, 0, CAST({micros} % 86400000000 AS DECIMAL(18, 6)) / 1000000)"
    )


def date(day: dt.date) -> str:
    """A date literal."""
    return f"DATE '{day.isoformat()}'"


def is_cube(log: DataFrame) -> bool:
    """Whether these are rows of an activity cube rather than of a task log."""
    return {"day", "timed", "dur_s", "dur_us"} <= set(log.columns)


def day_of(log: DataFrame) -> str:
    """Day of completion: the stored log's partition column or the timestamp's date; in a
    table derived from a log, which has no times, its ``day``."""
    if "completed_date" in log.columns:
        return "completed_date"
    has_own = "day" in log.columns and "completed_at" not in log.columns
    return "day" if has_own else "to_date(completed_at)"


def month_of(log: DataFrame) -> str:
    """Month of completion as the date of its first day, a cheap grouping key."""
    return f"trunc({day_of(log)}, 'month')"


def month_text(month: str) -> str:
    """``yyyy-MM``."""
    return f"substring(CAST({month} AS STRING), 1, 7)"


def interval_us(interval: str) -> str:
    """A day-time interval as a BIGINT of microseconds."""
    i = interval
    return (
        f"((CAST(extract(DAY FROM {i}) AS BIGINT) * 86400 + extract(HOUR FROM {i}) * 3600"
        f" + extract(MINUTE FROM {i}) * 60) * {MICROS}"
        f" + CAST(extract(SECOND FROM {i}) * {MICROS} AS BIGINT))"
    )
