"""Durations, as SQL text: parsing, and the forms the reports show.

A duration is a BIGINT of microseconds; a shown duration is whole seconds.
"""

from __future__ import annotations

from worklens.config import MICROS
from worklens.functions.text import shape

_CLOCK = (
    "'^[ \\\\t]*(?:(-?[0-9]+) *days?,? *)?"
    "(?:([+-])?([0-9]+):([0-9]+):([0-9]+)(?:[.]([0-9]+))?)?[ \\\\t]*$'"
)


def parse_duration(text: str) -> str:
    """``HH:MM:SS[.f]``, ``N days`` or ``N days [+]HH:MM:SS[.f]`` to microseconds, else null.

    The two usual shapes are told by their digits alone; only other texts meet
    the pattern.
    """
    tail = f"substring_index({text}, ' days ', -1)"
    head = f"substring_index({text}, ' days ', 1)"
    clock = (
        f"CAST(substring({tail}, 1, 2) AS BIGINT) * 3600"
        f" + CAST(substring({tail}, 4, 2) AS BIGINT) * 60"
        f" + CAST(substring({tail}, 7, 2) AS BIGINT)"
    )
    plain = f"{shape(text)} = '00:00:00'"
    in_days = (
        f"{shape(tail)} = '00:00:00' AND length({text}) = length({head}) + 14"
        f" AND ltrim('0', {shape(head)}) = ''"
    )
    return (
        f"CASE WHEN {plain} THEN ({clock}) * {MICROS}"
        f" WHEN {in_days} THEN (try_cast({head} AS BIGINT) * 86400 + {clock}) * {MICROS}"
        f" WHEN {text} RLIKE {_CLOCK} AND {text} RLIKE '[0-9]' THEN {_by_pattern(text)} END"
    )


def _by_pattern(text: str) -> str:
    """The pattern's groups, matched once and bound to a name.

    The lambda also keeps this rare branch out of the generated code, which must
    stay small enough for the JVM to compile.
    """

    def number(group: int) -> str:
        return f"coalesce(try_cast(p[{group}] AS BIGINT), 0L)"

    groups = f"split(regexp_replace({text}, {_CLOCK}, '$1|$2|$3|$4|$5|$6'), '[|]', -1)"
    micros = "CAST(substring(rpad(p[5], 6, '0'), 1, 6) AS BIGINT)"
    clock = f"(({number(2)} * 3600 + {number(3)} * 60 + {number(4)}) * {MICROS} + {micros})"
    micros_of = f"{number(0)} * {86_400 * MICROS} + IF(p[1] = '-', -1, 1) * {clock}"
    return f"transform(array({groups}), p -> {micros_of})[0]"


def hms(seconds: str) -> str:
    """``HH:MM:SS``; a missing value shows as zero."""
    s = f"coalesce({seconds}, 0L)"
    return f"format_string('%02d:%02d:%02d', {s} div 3600, {s} % 3600 div 60, {s} % 60)"


def min_sec(seconds: str) -> str:
    """``M min Ss``; a missing value shows as ``0 min``."""
    return (
        f"CASE WHEN {seconds} IS NULL THEN '0 min'"
        f" ELSE format_string('%d min %ds', {seconds} div 60, {seconds} % 60) END"
    )


def m_ss(seconds: str) -> str:
    """``M:SS``, null kept."""
    return (
        f"CASE WHEN {seconds} IS NOT NULL"
        f" THEN format_string('%d:%02d', {seconds} div 60, {seconds} % 60) END"
    )


def h_mm_ss(seconds: str) -> str:
    """``[N day(s), ]H:MM:SS``; a missing value shows as ``00:00:00``."""
    s = seconds
    clock = (
        f"format_string('%d:%02d:%02d', {s} % 86400 div 3600, {s} % 3600 div 60, {s} % 60)"
    )
    days = (
        f"CASE {s} div 86400 WHEN 0 THEN '' WHEN 1 THEN '1 day, '"
        f" ELSE format_string('%d days, ', {s} div 86400) END"
    )
    return f"CASE WHEN {s} IS NULL THEN '00:00:00' ELSE concat({days}, {clock}) END"


def hours_min_sec(micros: str) -> str:
    """``Xh Ym Zs`` from one hour on, else ``X min Zs``; the seconds are rounded."""
    minutes = f"{micros} div {60 * MICROS}"
    seconds = f"({micros} % {60 * MICROS} + {MICROS // 2}) div {MICROS}"
    return (
        f"CASE WHEN {minutes} >= 60 THEN format_string('%dh %dm %ds',"
        f" {minutes} div 60, {minutes} % 60, {seconds})"
        f" WHEN {micros} IS NOT NULL THEN format_string('%d min %ds', {minutes}, {seconds}) END"
    )


def hours_minutes(seconds: str) -> str:
    """``Hh Mm`` of whole minutes."""
    return f"format_string('%dh %dm', {seconds} div 3600, {seconds} % 3600 div 60)"
