"""Reports over a period, for a selection of analysts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.config import DEFAULT, MICROS, Vocabulary
from worklens.functions.calendar import date, day_of
from worklens.functions.durations import h_mm_ss, hms
from worklens.functions.measures import (
    SUMS,
    mean_s,
    mean_s_of,
    or_zero,
    tasks,
    totals,
    with_measures,
)
from worklens.functions.sql import among, equals, exprs, named
from worklens.operators.filters import (
    Roster,
    filter_analysts,
    filter_period,
    in_period,
    roster_table,
)
from worklens.operators.idle import idle_by_day, idle_time_mean
from worklens.operators.individual import team_tmo
from worklens.operators.rankings import rank_registration
from worklens.plans.cube import activity_cube


def _for_roster(log: DataFrame, roster: Roster, figures: DataFrame) -> DataFrame:
    """Every selected analyst with their figures, also those without any."""
    names = roster_table(log.sparkSession, log, roster)
    return names.join(figures, "analyst", "left")


def period_summary(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    roster: Roster = None,
    registered_only: bool = False,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Per selected analyst: mean known duration and tasks, of production or registrations."""
    outcomes = (vocabulary.registered,) if registered_only else vocabulary.production
    relevant = with_measures(filter_period(log, first, last)).filter(among("outcome", outcomes))
    figures = (
        filter_analysts(relevant, roster)
        .groupBy("analyst")
        .agg(*exprs({"tmo_s": mean_s(), "tasks": tasks()}))
    )
    return _for_roster(log, roster, figures).selectExpr(
        "analyst",
        "tmo_s",
        f"{hms('tmo_s')} AS tmo",
        f"{or_zero('tasks')} AS tasks",
        f"{date(first)} AS period_start",
        f"{date(last)} AS period_end",
    )


def period_summary_band(summary: DataFrame) -> DataFrame:
    """A period summary with a colour: against the unweighted mean of the analysts' means.

    Green below 90 %, yellow up to 110 %, red above; compared in whole numbers.
    """
    scaled = summary.selectExpr(
        "*",
        "tmo_s * 10 * count(tmo_s) OVER () AS scaled",
        "sum(tmo_s) OVER () AS whole",
    )
    return scaled.selectExpr(
        "*",
        "CASE WHEN scaled < whole * 9 THEN 'green' WHEN scaled <= whole * 11 THEN 'yellow'"
        " WHEN scaled IS NOT NULL THEN 'red' END AS band",
    ).drop("scaled", "whole")


def cause_by_analyst(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    roster: Roster = None,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Per selected analyst and known cause: registered tasks of the period."""
    registered = filter_period(log, first, last).filter(
        f"cause IS NOT NULL AND {equals('outcome', vocabulary.registered)}"
    )
    return (
        filter_analysts(registered, roster)
        .groupBy("analyst", "cause")
        .agg(*exprs({"tasks": "count(*)"}))
    )


def period_registered_updated(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    roster: Roster = None,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Per selected analyst: mean known duration and tasks, registered and updated."""
    registered = equals("outcome", vocabulary.registered)
    updated = equals("outcome", vocabulary.updated)
    handled = with_measures(filter_period(log, first, last)).filter(
        among("outcome", vocabulary.handled)
    )
    figures = (
        filter_analysts(handled, roster)
        .groupBy("analyst")
        .agg(
            *exprs(
                {
                    "registered_s": mean_s(registered),
                    "registered": tasks(registered),
                    "updated_s": mean_s(updated),
                    "updated": tasks(updated),
                }
            )
        )
    )
    return _for_roster(log, roster, figures).selectExpr(
        "analyst",
        f"{h_mm_ss('registered_s')} AS registered_tmo",
        f"{or_zero('registered')} AS registered",
        f"{h_mm_ss('updated_s')} AS updated_tmo",
        f"{or_zero('updated')} AS updated",
    )


def analyst_daily_detail(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    roster: Roster = None,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Per selected analyst and day: time of registered tasks over their number."""
    registered = with_measures(filter_period(log, first, last)).filter(
        equals("outcome", vocabulary.registered)
    )
    chosen = filter_analysts(registered, roster)
    if "day" not in chosen.columns:
        chosen = chosen.selectExpr("*", f"{day_of(log)} AS day")
    return chosen.groupBy("analyst", "day").agg(
        *exprs({"tmo": hms(mean_s(per="n")), "tasks": tasks()})
    )


def period_full_summary(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    roster: Roster = None,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Per selected analyst: means, registrations, all tasks and idle time of the period."""
    chosen = filter_analysts(filter_period(log, first, last), roster)
    registered = equals("outcome", vocabulary.registered)
    figures = (
        with_measures(chosen)
        .groupBy("analyst")
        .agg(
            *exprs(
                {
                    "overall_s": mean_s(among("outcome", vocabulary.production)),
                    "registered_s": mean_s(registered),
                    "registered": tasks(registered),
                    "tasks": tasks(),
                }
            )
        )
    )
    idle = idle_by_day(chosen).groupBy("analyst").agg(
        *exprs({"idle_s": f"sum(idle_us) div {MICROS}"})
    )
    return _for_roster(log, roster, figures.join(idle, "analyst", "left")).selectExpr(
        "analyst",
        f"{h_mm_ss('overall_s')} AS overall_tmo",
        f"{h_mm_ss('registered_s')} AS registered_tmo",
        f"{or_zero('registered')} AS registered",
        f"{or_zero('tasks')} AS tasks",
        f"{h_mm_ss(or_zero('idle_s'))} AS idle",
    )


def period_comparison(
    log: DataFrame,
    before: tuple[dt.date, dt.date],
    after: tuple[dt.date, dt.date],
    roster: Roster = None,
    vocabulary: Vocabulary = DEFAULT,
) -> DataFrame:
    """Per analyst seen in either period: mean known durations in each; they may overlap."""
    periods = {"before": in_period(log, *before), "after": in_period(log, *after)}
    outcomes = {"registered": vocabulary.registered, "updated": vocabulary.updated}
    either = with_measures(log.filter(f"{periods['before']} OR {periods['after']}"))
    seen = filter_analysts(either, roster).filter("analyst IS NOT NULL")
    means = {
        f"{kind}_{when}": or_zero(mean_s(f"{equals('outcome', word)} AND {inside}"))
        for kind, word in outcomes.items()
        for when, inside in periods.items()
    }
    compared = seen.groupBy("analyst").agg(*exprs(means))
    shown = {f"{name}_tmo": hms(name) for name in means}
    shown |= {f"registered_{when}_min": f"registered_{when} div 60" for when in periods}
    return compared.selectExpr("analyst", *named(shown))


def registration_report(
    log: DataFrame, first: dt.date, last: dt.date, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Per analyst: mean known duration and number of registrations, beside the overall mean."""
    registered = filter_period(log, first, last).filter(
        equals("outcome", vocabulary.registered)
    )
    parts = ("dur_s", "dur_us", "timed")
    means = {
        "tmo_s": mean_s_of(*parts),
        "overall_s": mean_s_of(*[f"sum({part}) OVER ()" for part in parts]),
    }
    sums = with_measures(registered).groupBy("analyst").agg(*exprs(totals()))
    return (
        sums.selectExpr("analyst", "n", *named(means))
        .filter("analyst IS NOT NULL")
        .selectExpr(
            "analyst",
            f"{hms('tmo_s')} AS tmo",
            f"{or_zero('tmo_s')} div 60 AS tmo_min",
            "n AS tasks",
            f"'{first:%Y-%m}' AS month",
            f"{hms('overall_s')} AS overall_tmo",
        )
    )


def analyst_scorecard(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    vocabulary: Vocabulary = DEFAULT,
    idle_days: DataFrame | None = None,
) -> DataFrame:
    """Per analyst of the period: means, mean daily idle time, and the mean of each queue.

    One row per analyst and queue with handled tasks; the queue is null for an
    analyst without any. A figure without data shows as ``N/A``. ``idle_days`` is the idle
    time of the period, if it is at hand from stored summaries.
    """
    chosen = filter_analysts(filter_period(log, first, last))
    handled = among("outcome", vocabulary.handled)
    sums = {"handled": tasks(handled), "queue_s": mean_s(handled)}
    sums |= totals(SUMS, equals("outcome", vocabulary.registered), "registered_")
    sums |= totals(SUMS, equals("outcome", vocabulary.updated), "updated_")
    per_queue = with_measures(chosen).groupBy("analyst", "queue").agg(*exprs(sums))

    # the figures of an analyst are sums over their queues, so one scan serves both
    def mean(kind: str) -> str:
        parts = [f"{kind}_{m}" for m in ("dur_s", "dur_us", "timed")]
        return mean_s_of(*[f"sum({part}) OVER (PARTITION BY analyst)" for part in parts])

    def shown(seconds: str) -> str:
        return f"IF({seconds} IS NULL, 'N/A', {hms(seconds)})"

    listed = "(queue IS NOT NULL AND handled > 0)"
    figures = per_queue.selectExpr(
        "analyst",
        f"IF({listed}, queue, NULL) AS queue",
        f"IF({listed}, {shown('queue_s')}, NULL) AS queue_tmo",
        f"{mean('registered')} AS registered_s",
        f"{mean('updated')} AS updated_s",
        f"max({listed}) OVER (PARTITION BY analyst) AS any_listed",
        "row_number() OVER (PARTITION BY analyst ORDER BY queue) AS place",
    ).filter("queue IS NOT NULL OR (NOT any_listed AND place = 1)")
    return figures.join(
        idle_time_mean(chosen if idle_days is None else idle_days), "analyst", "left"
    ).selectExpr(
        "analyst",
        f"{shown('registered_s')} AS registered_tmo",
        f"{shown('updated_s')} AS updated_tmo",
        f"{shown('idle_mean_s')} AS idle_mean",
        "queue",
        "queue_tmo",
    )


def team_card(
    log: DataFrame,
    first: dt.date,
    last: dt.date,
    top: int = 5,
    roster: Roster = None,
    cube: DataFrame | None = None,
    vocabulary: Vocabulary = DEFAULT,
    idle_days: DataFrame | None = None,
) -> DataFrame:
    """The team at a glance, one row per figure: top registrants, means, idle time, peak day.

    All but the idle time comes from an activity cube: the one at hand, or one made
    here; Spark reads the log once per different filter on it. ``idle_days`` is the idle time
    of the period from stored summaries; with it and a stored cube the log is not read.
    """
    log = filter_period(log, first, last)
    if cube is None:
        cube = activity_cube(log)
    summed = filter_period(cube, first, last)
    no_position = "CAST(NULL AS BIGINT) AS position"
    ranked = (
        rank_registration(summed, roster, vocabulary)
        .filter(f"position <= {top}")
        .selectExpr("'top_registrant' AS item", "position", "analyst AS label", "total AS value")
    )
    kinds = ["registered_tmo_s", "updated_tmo_s", "audited_tmo_s"]
    means = (
        team_tmo(summed, vocabulary)
        .unpivot([], kinds, "item", "value")
        .selectExpr("item", no_position, f"{hms('value')} AS label", "value")
    )
    idle = (
        idle_by_day(log if idle_days is None else idle_days)
        .selectExpr(f"sum(idle_us) div nullif(count(idle_us) * {MICROS}, 0L) AS value")
        .selectExpr("'idle_mean_s' AS item", no_position, f"{hms('value')} AS label", "value")
    )
    registered = with_measures(summed.filter(equals("outcome", vocabulary.registered)))
    peak = (
        registered.selectExpr(f"{day_of(summed)} AS on_day", "n")
        .filter("on_day IS NOT NULL")
        .groupBy("on_day")
        .agg(*exprs({"value": tasks()}))
        .orderBy("value", "on_day", ascending=[False, True])
        .limit(1)
        .selectExpr("'peak_day' AS item", no_position, "CAST(on_day AS STRING) AS label", "value")
    )
    return ranked.unionByName(means).unionByName(idle).unionByName(peak)


def data_question_aggregates(log: DataFrame) -> DataFrame:
    """Mean known duration and tasks of each analyst, and of the whole log.

    Names that differ in case only are one analyst, shown in lower case.
    """
    keyed = with_measures(log).withColumn("analyst", F.lower("analyst"))
    sums = keyed.groupBy("analyst").agg(*exprs(totals()))
    rolled = sums.rollup("analyst").agg(
        *exprs({"is_overall": "grouping(analyst) = 1", "tmo_s": mean_s(), "tasks": tasks()})
    )
    return rolled.filter("is_overall OR analyst IS NOT NULL").selectExpr(
        "analyst", "is_overall", "tmo_s", f"{hms('tmo_s')} AS tmo", "tasks"
    )
