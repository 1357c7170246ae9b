"""From a raw export to a clean task log."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.config import (
    DEFAULT,
    DURATION_CEILING,
    REGISTERED_FLOOR,
    REGISTERED_MIN,
    UPDATED_CEILING,
    UPDATED_FLOOR,
    Vocabulary,
)
from worklens.functions.calendar import (
    day_of,
    interval_us,
    month_of,
    month_text,
    parse_task_time,
    time_of_nanos,
)
from worklens.functions.durations import parse_duration
from worklens.functions.sql import equals, text
from worklens.schema import TASK_LOG

def drop_listed_columns(df: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Drop the unwanted columns, whatever the case and outer blanks of their names."""
    listed = set(vocabulary.dropped_columns)
    dropped = [c for c in df.columns if c.upper().strip() in listed]
    # drop() takes plain names: a dot in one of them is part of the name
    return df.drop(*dropped) if dropped else df


def rename_headers(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Spreadsheet headers to our names; two headers of one name are coalesced."""
    sources: dict[str, list[str]] = {}
    for c in df.columns:
        sources.setdefault(headers.get(c.strip(), c), []).append(f"`{c}`")
    return df.selectExpr(
        *[f"coalesce({', '.join(found)}) AS `{name}`" for name, found in sources.items()]
    )


#: What the names of columns that we do not know begin with.
EXTRA = "x_"
_INTEGERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def _duration(source: str, kind: T.DataType, unit: str | None) -> str:
    """Text, an interval, or a whole number of ``unit`` to microseconds."""
    if isinstance(kind, T.DayTimeIntervalType):
        return interval_us(f"CAST({source} AS INTERVAL DAY TO SECOND)")
    if isinstance(kind, _INTEGERS):
        if unit is None:
            raise ValueError(f"column {source} holds whole numbers: name their duration_unit")
        return {"ns": f"{source} div 1000", "us": source, "s": f"{source} * 1000000"}[unit]
    if isinstance(kind, (T.StringType, T.NullType)):
        return parse_duration(source)
    raise TypeError(f"column {source} holds {kind.simpleString()}, which is not a duration")


def standardise_task_log(raw: DataFrame, duration_unit: str | None = None) -> DataFrame:
    """Type a raw log: unreadable values become null, absent columns are added.

    Columns ``duration`` and ``analysis`` become ``duration_us`` and ``analysis_us``,
    from text, an interval, or whole numbers of ``duration_unit`` (ns, us or s), which must
    be named for them; another type is an error. A time may be text, a timestamp, or whole nanoseconds. Columns
    we do not know are kept with ``x_`` before their names, so that none is taken for one
    of ours. Adds the ``completed_date`` and ``completed_month`` keys.
    """
    have = {f.name: f.dataType for f in raw.schema}
    columns: list[str] = []
    for field in TASK_LOG:
        name, kind = field.name, field.dataType
        source = name.removesuffix("_us")
        if name in have:
            is_time = isinstance(kind, T.TimestampNTZType)
            if is_time and isinstance(have[name], T.StringType):
                typed = parse_task_time(name)
            elif is_time and isinstance(have[name], T.LongType):
                typed = time_of_nanos(name)
            else:
                typed = f"try_cast({name} AS {kind.simpleString()})"
        elif source != name and source in have:
            typed = _duration(source, have[source], duration_unit)
        elif name == "justification":
            typed = "''"
        else:
            typed = f"CAST(NULL AS {kind.simpleString()})"
        columns.append(f"{typed} AS {name}")
    known = {f.name for f in TASK_LOG} | {"duration", "analysis"}
    out = raw.selectExpr(*columns, *extra_columns([c for c in have if c not in known]))
    return out.selectExpr(
        "*",
        f"{day_of(out)} AS completed_date",
        f"{month_text(month_of(out))} AS completed_month",
    )


def extra_columns(names: Iterable[str]) -> list[str]:
    """Columns we do not know, under their prefixed names."""
    return [f"`{c}` AS `{c if c.startswith(EXTRA) else EXTRA + c}`" for c in names]


def exclude_robot_and_unassigned(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Keep tasks a person completed."""
    robot = text(vocabulary.robot_user.lower())
    return log.filter(f"analyst IS NOT NULL AND lower(analyst) <> {robot}")


def clamped_duration(vocabulary: Vocabulary = DEFAULT) -> str:
    """The duration within its limits. The two-hour ceiling overrides the others."""
    registered = equals("outcome", vocabulary.registered)
    updated = equals("outcome", vocabulary.updated)
    return (
        f"CASE WHEN duration_us > {DURATION_CEILING}L THEN {DURATION_CEILING}L"
        f" WHEN {registered} AND duration_us < {REGISTERED_MIN}L THEN {REGISTERED_FLOOR}L"
        f" WHEN {updated} AND duration_us < {UPDATED_FLOOR}L THEN {UPDATED_FLOOR}L"
        f" WHEN {updated} AND duration_us > {UPDATED_CEILING}L THEN {UPDATED_CEILING}L"
        " ELSE duration_us END"
    )


def clamp_durations(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Bring the durations within their limits, once per batch: not idempotent."""
    if not {"duration_us", "outcome"} <= set(log.columns):
        return log
    return log.withColumn("duration_us", F.expr(clamped_duration(vocabulary)))


def duration_adjustments(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """The durations ``clamp_durations`` changes, before and after."""
    return log.selectExpr(
        "protocol_id",
        "outcome",
        "duration_us AS duration_before_us",
        f"{clamped_duration(vocabulary)} AS duration_after_us",
    ).filter("duration_before_us <> duration_after_us")


#: What is logged of a change.
ADJUSTMENTS = (
    "protocol_id", "outcome", "duration_before_us", "duration_us AS duration_after_us",
)


def adjustments_of(stored: DataFrame) -> DataFrame:
    """The rows of a stored log whose duration the cleaning changed."""
    return stored.filter("duration_before_us <> duration_us")


def clean_batch(batch: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """The cleaning of one batch: drop columns, drop robot rows, clamp durations."""
    kept = drop_listed_columns(batch, vocabulary)
    return clamp_durations(exclude_robot_and_unassigned(kept, vocabulary), vocabulary)


def append_batch(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """All rows of both; columns only one of them has are null in the other."""
    return stored.unionByName(batch, allowMissingColumns=True)


def export_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The chosen columns, each as the text a CSV file shows."""
    return df.selectExpr(*[f"CAST(`{c}` AS STRING) AS `{c}`" for c in columns])
