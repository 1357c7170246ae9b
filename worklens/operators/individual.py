"""Figures of each analyst, for all analysts in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from worklens.config import (
    DEFAULT,
    FAST_PORTFOLIO_LIMIT,
    MICROS,
    PORTFOLIO_LIMIT,
    Vocabulary,
)
from worklens.functions.calendar import day_of
from worklens.functions.durations import hms, m_ss, min_sec
from worklens.functions.measures import (
    mean_s,
    mean_s_of,
    mean_us,
    mean_us_of,
    or_zero,
    tasks,
    totals,
    with_measures,
)
from worklens.functions.sql import among, differs, equals, exprs, named, text
from worklens.functions.text import protocol_text
from worklens.operators.filters import is_doubt_outlier
from worklens.operators.overview import TMO_KINDS, monthly_means, monthly_shown


def _with_day(log: DataFrame) -> DataFrame:
    """Measured tasks of known analysts, with their day."""
    named_rows = with_measures(log).filter("analyst IS NOT NULL")
    if "day" in named_rows.columns:
        return named_rows
    return named_rows.selectExpr("*", f"{day_of(log)} AS day")


def _counted_kinds(log: DataFrame, vocabulary: Vocabulary) -> dict[str, str]:
    """Which tasks count: not those of the unknown queue, nor doubt outliers."""
    unknown = differs("queue", vocabulary.unknown_queue)
    counts = f"{unknown} AND NOT {is_doubt_outlier(log, vocabulary)}"
    return {
        "registered": f"{equals('outcome', vocabulary.registered)} AND {counts}",
        "updated": f"{equals('outcome', vocabulary.updated)} AND {counts}",
        "distributed": f"{equals('outcome', vocabulary.distributed)} AND {counts}",
    }


def _parts(kind: str, count: str = "n") -> tuple[str, str, str]:
    return (f"{kind}_dur_s", f"{kind}_dur_us", f"{kind}_{count}")


def analyst_metrics(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Counts, mean times over all counted tasks, days worked and registrations per day."""
    log = _with_day(log)
    kinds = _counted_kinds(log, vocabulary)
    sums: dict[str, str] = {}
    for kind, when in kinds.items():
        sums |= totals(("n", "dur_s", "dur_us"), when, f"{kind}_")
    # summed per day first, so that counting days needs no distinct
    daily = log.groupBy("analyst", "day").agg(*exprs(sums))
    per_analyst = daily.groupBy("analyst").agg(
        *exprs(
            {name: f"sum({name})" for name in sums}
            | {"days_worked": "count_if(registered_n > 0 AND day IS NOT NULL)"}
        )
    )
    overall = ["(" + " + ".join(column) + ")" for column in zip(*[_parts(k) for k in kinds])]
    return per_analyst.selectExpr(
        "analyst",
        *[f"{kind}_n AS {kind}" for kind in kinds],
        f"{overall[2]} AS total",
        f"{or_zero(mean_s_of(*overall))} AS tmo_s",
        f"{or_zero(mean_s_of(*_parts('registered')))} AS registered_tmo_s",
        f"{or_zero(mean_s_of(*_parts('updated')))} AS updated_tmo_s",
        "days_worked",
        f"{or_zero('registered_n div nullif(days_worked, 0L)')} AS registered_per_day",
    )


def team_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """One row: mean known duration registered, updated, audited and of the three outcomes."""
    return with_measures(log).selectExpr(
        *named(
            {
                "registered_tmo_s": mean_s(equals("outcome", vocabulary.registered)),
                "updated_tmo_s": mean_s(equals("outcome", vocabulary.updated)),
                "audited_tmo_s": mean_s(equals("outcome", vocabulary.audited)),
                "overall_tmo_s": mean_s(among("outcome", vocabulary.production)),
            }
        )
    )


def analyst_vs_team(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Analysts against the team mean: who takes longer to register, to update.

    Both come from one scan: the team's sums are those of the per-analyst rows.
    """
    log = with_measures(log)
    counted = _counted_kinds(log, vocabulary)
    whole = {"registered": vocabulary.registered, "updated": vocabulary.updated}
    sums: dict[str, str] = {}
    for kind, word in whole.items():
        sums |= totals(("n", "dur_s", "dur_us"), counted[kind], f"{kind}_")
        sums |= totals(("timed", "dur_s", "dur_us"), equals("outcome", word), f"team_{kind}_")
    means = {}
    for kind in whole:
        team = [f"sum({part}) OVER ()" for part in _parts(f"team_{kind}", "timed")]
        means[f"{kind}_us"] = or_zero(mean_us_of(*_parts(kind)))
        means[f"team_{kind}_us"] = mean_us_of(*team)
    compared = log.groupBy("analyst").agg(*exprs(sums)).selectExpr("analyst", *named(means))
    shown = {}
    for kind in whole:
        shown |= {
            f"{kind}_tmo_s": f"{kind}_us div {MICROS}",
            f"team_{kind}_tmo_s": f"team_{kind}_us div {MICROS}",
            f"{kind}_over_team": f"coalesce({kind}_us > team_{kind}_us, false)",
        }
    return compared.filter("analyst IS NOT NULL").selectExpr("analyst", *named(shown))


def _registered_days(log: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    registered = _with_day(log).filter(
        f"{equals('outcome', vocabulary.registered)} AND day IS NOT NULL"
    )
    return registered.groupBy("analyst", "day").agg(
        *exprs({"n": tasks(), "mean_us": mean_us(), "tmo_s": mean_s()})
    )


def _first_day(days: DataFrame, order: str) -> DataFrame:
    place = f"row_number() OVER (PARTITION BY analyst ORDER BY {order}, day) AS place"
    return days.selectExpr("*", place).filter("place = 1")


def best_day_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst: the day with the lowest mean of registered tasks; the earliest if equal."""
    days = _registered_days(log, vocabulary).filter("mean_us IS NOT NULL")
    return _first_day(days, "mean_us").selectExpr(
        "analyst", "day", "tmo_s", f"{min_sec('tmo_s')} AS tmo_text"
    )


def best_day_volume(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst: the day with the most registrations; the earliest if equal."""
    days = _registered_days(log, vocabulary)
    return _first_day(days, "n DESC").selectExpr("analyst", "day", "n AS registered")


def analyst_queue_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst and queue: handled tasks, audits and distributions as separate rows,
    the largest first."""
    registered = equals("outcome", vocabulary.registered)
    updated = equals("outcome", vocabulary.updated)
    handled = among("outcome", vocabulary.handled)
    audit = (
        f"({equals('queue', vocabulary.audit_queue)}"
        f" AND {equals('outcome', vocabulary.audited)})"
    )
    spread = (
        f"({among('queue', vocabulary.distribution_queues)}"
        f" AND {equals('outcome', vocabulary.distributed)})"
    )
    sums = (
        with_measures(log)
        .filter(
            "analyst IS NOT NULL AND queue IS NOT NULL"
            f" AND ({handled} OR {audit} OR {spread})"
        )
        .groupBy("analyst", "queue")
        .agg(
            *exprs(
                {
                    "handled": tasks(handled),
                    "audit": tasks(audit),
                    "distribution": tasks(spread),
                    "registered_s": mean_s(registered),
                    "updated_s": mean_s(updated),
                    "audit_s": mean_s(audit),
                    "distribution_s": mean_s(spread),
                }
            )
        )
    )
    shown = {
        "handled": ("registered", "updated"),
        "audit": ("audit",),
        "distribution": ("distribution",),
    }
    times = ("registered", "updated", "audit", "distribution")
    parts = ", ".join(
        f"named_struct('part', '{part}', 'tasks', {part}, "
        + ", ".join(
            f"'{t}_s', " + (f"{t}_s" if t in kept else "CAST(NULL AS BIGINT)") for t in times
        )
        + ")"
        for part, kept in shown.items()
    )
    rows = sums.selectExpr("analyst", "queue", f"inline(array({parts}))").filter("tasks > 0")
    return rows.selectExpr(
        "analyst", "queue", "part", "tasks", *named({f"{t}_tmo": hms(f"{t}_s") for t in times})
    ).orderBy("analyst", F.desc("tasks"), "queue", "part")


def queue_tmo_finished(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst and queue: finished tasks and their mean known duration."""
    finished = with_measures(log).filter(
        f"analyst IS NOT NULL AND queue IS NOT NULL AND {equals('status', vocabulary.finished)}"
    )
    out = finished.groupBy("analyst", "queue").agg(
        *exprs({"tasks": tasks(), "tmo_s": mean_s()})
    )
    return out.selectExpr("*", f"{min_sec('tmo_s')} AS tmo_text")


def analyst_monthly_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst and month: mean times; overall includes audits, missing is zero."""
    overall = (*vocabulary.production, vocabulary.audited)
    means = monthly_means(log, overall, ("analyst",), vocabulary)
    filled = {f"{k}_tmo_s": or_zero(f"{k}_tmo_s") for k in TMO_KINDS}
    return monthly_shown(means.selectExpr("analyst", "month", *named(filled)))


def daily_task_count(log: DataFrame) -> DataFrame:
    """Per analyst and day: tasks."""
    keyed = _with_day(log).filter("day IS NOT NULL")
    return keyed.groupBy("analyst", "day").agg(*exprs({"tasks": tasks()}))


def queue_counts(log: DataFrame) -> DataFrame:
    """Per analyst and known queue: tasks, most first."""
    keyed = with_measures(log).filter("analyst IS NOT NULL AND queue IS NOT NULL")
    counts = keyed.groupBy("analyst", "queue").agg(*exprs({"tasks": tasks()}))
    return counts.orderBy("analyst", F.desc("tasks"), "queue")


def cause_counts(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst and known cause: registered tasks, most first."""
    registered = log.filter(
        f"analyst IS NOT NULL AND cause IS NOT NULL"
        f" AND {equals('outcome', vocabulary.registered)}"
    )
    counts = registered.groupBy("analyst", "cause").agg(*exprs({"tasks": "count(*)"}))
    return counts.orderBy("analyst", F.desc("tasks"), "cause")


def _portfolio_rows(log: DataFrame, vocabulary: Vocabulary) -> GroupedData:
    statuses = (
        vocabulary.portfolio_closed,
        vocabulary.portfolio_reclassified,
        vocabulary.portfolio_in_progress,
    )
    listed = log.filter(
        "analyst IS NOT NULL AND portfolio IS NOT NULL"
        f" AND {among('portfolio_status', statuses)}"
    )
    return with_measures(listed, "analysis_us").groupBy("analyst", "portfolio")


def portfolio_status_counts(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst and portfolio: tasks per status; mean analysis of those no longer open."""
    done = (vocabulary.portfolio_closed, vocabulary.portfolio_reclassified)

    def having(status: str) -> str:
        return tasks(equals("portfolio_status", status))

    out = _portfolio_rows(log, vocabulary).agg(
        *exprs(
            {
                "closed": having(vocabulary.portfolio_closed),
                "reclassified": having(vocabulary.portfolio_reclassified),
                "in_progress": having(vocabulary.portfolio_in_progress),
                "tmo_s": mean_s(among("portfolio_status", done)),
            }
        )
    )
    return out.selectExpr("*", f"{min_sec('tmo_s')} AS tmo_text")


def portfolio_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst and portfolio: tasks and mean analysis time."""
    return _portfolio_rows(log, vocabulary).agg(*exprs({"tasks": tasks(), "tmo_s": mean_s()}))


def points_of_attention(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Tasks analysed for longer than their portfolio allows."""
    limit = (
        f"IF(portfolio <=> {text(vocabulary.fast_portfolio)},"
        f" {FAST_PORTFOLIO_LIMIT}L, {PORTFOLIO_LIMIT}L)"
    )
    late = log.filter(f"analysis_us > {limit} AND protocol_id IS NOT NULL")
    return late.selectExpr(
        f"{protocol_text('protocol_id')} AS protocol_id",
        "portfolio",
        f"{m_ss(f'(analysis_us div {MICROS})')} AS analysis_time",
    )
