"""Whole-team aggregations: totals, queues, groups, days, months, audit findings.

Every function takes the task log. Those that only need days, analysts, queues,
outcomes and statuses also take an activity cube, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.config import DEFAULT, MICROS, Vocabulary
from worklens.functions.calendar import day_of, is_cube, month_of, month_text
from worklens.functions.durations import hms, hours_min_sec, min_sec
from worklens.functions.measures import mean_s, mean_us, or_zero, tasks, total, with_measures
from worklens.functions.sql import (
    among,
    differs,
    equals,
    exprs,
    named,
    not_among,
    order_of,
    text,
)
from worklens.functions.text import strip
from worklens.operators.filters import drop_doubt_outliers


def overview_kpis(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """One row: tasks and mean time per outcome and overall (audits are not in the total)."""
    kinds = {
        "registered": equals("outcome", vocabulary.registered),
        "updated": equals("outcome", vocabulary.updated),
        "distributed": equals("outcome", vocabulary.distributed),
        "audited": equals("outcome", vocabulary.audited),
        "total": among("outcome", vocabulary.production),
    }
    figures = {kind: tasks(when) for kind, when in kinds.items()}
    figures |= {f"{kind}_tmo_s": or_zero(mean_s(when, "n")) for kind, when in kinds.items()}
    shown = {f"{kind}_tmo_text": min_sec(f"{kind}_tmo_s") for kind in kinds}
    return with_measures(log).selectExpr(*named(figures)).selectExpr("*", *named(shown))


def queue_summary(
    log: DataFrame, vocabulary: Vocabulary = DEFAULT, firsts: DataFrame | None = None
) -> DataFrame:
    """Per queue: handled tasks with their mean times, then distribution and audit rows.

    Tasks without a duration are left out. ``out_of_scope`` counts, over the
    first task of each protocol, those neither registered nor updated. A queue
    may show in two parts, as handled work and as distribution or audit work. A cube may take
    the log's place where ``firsts`` has the first tasks (see ``plans.first_tasks``).
    """
    timed = log if is_cube(log) else log.filter("duration_us IS NOT NULL")
    first_tasks = timed if firsts is None else firsts

    def tasks(when: str) -> str:
        return total("timed", when)

    registered = equals("outcome", vocabulary.registered)
    updated = equals("outcome", vocabulary.updated)
    handled = among("outcome", vocabulary.handled)
    spread = (
        f"{among('queue', vocabulary.distribution_queues)}"
        f" AND {equals('outcome', vocabulary.distributed)}"
    )
    audited = (
        f"{equals('queue', vocabulary.audit_queue)} AND {equals('outcome', vocabulary.audited)}"
    )
    outside = not_among("outcome", (*vocabulary.production, vocabulary.batch_closed))
    per_queue = (
        with_measures(timed)
        .filter("queue IS NOT NULL")
        .groupBy("queue")
        .agg(
            *exprs(
                {
                    "handled": tasks(handled),
                    "registered": tasks(registered),
                    "updated": tasks(updated),
                    "registered_s": mean_s(registered),
                    "updated_s": mean_s(updated),
                    "spread": tasks(spread),
                    "spread_s": mean_s(spread),
                    "audited": tasks(audited),
                    "audited_s": mean_s(audited),
                    "out_of_scope_s": mean_s(outside),
                }
            )
        )
    )
    listed = f"IF({differs('queue', vocabulary.unlisted_queue)}, handled, 0L)"
    none = "CAST(NULL AS BIGINT)"
    rows = {
        "handled": (listed, "registered", "updated", "registered_s", "updated_s"),
        "distribution": ("spread", none, none, "spread_s", none),
        "audit": ("audited", none, none, "audited_s", none),
    }
    parts = ", ".join(
        f"named_struct('part', '{name}', 'tasks', {n}, 'registered', {reg}, 'updated', {upd},"
        f" 'registered_s', {reg_s}, 'updated_s', {upd_s})"
        for name, (n, reg, upd, reg_s, upd_s) in rows.items()
    )
    shown = per_queue.selectExpr("queue", "out_of_scope_s", f"inline(array({parts}))").filter(
        "tasks > 0"
    )
    # First task of each protocol. min_by reduces within each map task first, so
    # a protocol shared by many rows (the missing one above all) stays small. What it
    # keeps is a number, the queue's hash with the outcome's kind as its last bit: a
    # buffer of fixed width, without which Spark would sort the whole log twice.
    code = "shiftleft(xxhash64(queue), 1)"
    unhandled = not_among("outcome", vocabulary.handled)
    coded = first_tasks.selectExpr(
        "protocol_id",
        f"{order_of(first_tasks.columns)} AS place",
        f"IF(queue IS NULL, NULL, {code} + CAST({unhandled} AS BIGINT)) AS task",
    )
    first = coded.groupBy("protocol_id").agg(F.expr("min_by(task, place) AS task"))
    scope = (
        first.filter("task IS NOT NULL")
        .groupBy(F.expr("task - (task & 1) AS code"))
        .agg(F.expr("count_if((task & 1) = 1) AS out_of_scope"))
    )
    return shown.join(scope, F.expr(f"{code} = code"), "left").selectExpr(
        "queue",
        "part",
        "tasks",
        "registered",
        "updated",
        "out_of_scope",
        f"{hms('registered_s')} AS registered_tmo",
        f"{hms('updated_s')} AS updated_tmo",
        f"{hms('out_of_scope_s')} AS out_of_scope_tmo",
    )


def queue_group(vocabulary: Vocabulary = DEFAULT) -> str:
    """Group of a queue; ``other_group`` if it is in none or unknown."""
    whens = " ".join(
        f"WHEN {among('queue', queues)} THEN {text(name)}"
        for name, queues in vocabulary.queue_groups
    )
    other = text(vocabulary.other_group)
    return f"CASE {whens} ELSE {other} END" if whens else other


def _outcome_split(vocabulary: Vocabulary) -> dict[str, str]:
    return {
        "registered": tasks(equals("outcome", vocabulary.registered)),
        "updated": tasks(equals("outcome", vocabulary.updated)),
        "neither": tasks(not_among("outcome", vocabulary.handled)),
    }


def production_by_group(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per queue group: registered, updated, neither (an unknown outcome is neither)."""
    grouped = with_measures(log).selectExpr("*", f"{queue_group(vocabulary)} AS queue_group")
    return grouped.groupBy("queue_group").agg(*exprs(_outcome_split(vocabulary)))


def outcome_by_module(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per module with handled work: registered and updated tasks side by side."""
    handled = log.filter(f"module IS NOT NULL AND {among('outcome', vocabulary.handled)}")
    return handled.groupBy("module").agg(
        *exprs(
            {
                "registered": f"count_if({equals('outcome', vocabulary.registered)})",
                "updated": f"count_if({equals('outcome', vocabulary.updated)})",
            }
        )
    )


def email_group_detail(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """The e-mail queue by task type, and the other queues of its group by queue."""
    is_email = equals("queue", vocabulary.email_queue)
    detail = (
        log.filter(f"{is_email} OR {among('queue', vocabulary.email_other_queues)}")
        .selectExpr(
            f"{is_email} AS is_email",
            f"IF({is_email}, task_type, queue) AS item",
            "outcome",
            "1L AS n",
        )
        .filter("item IS NOT NULL")
    )
    return (
        detail.groupBy("is_email", "item")
        .agg(*exprs({"tasks": tasks(), **_outcome_split(vocabulary)}))
        .drop("is_email")
    )


def _daily(log: DataFrame, by: Sequence[str], measures: dict[str, str]) -> DataFrame:
    keys = (*by, "day")
    keyed = with_measures(log)
    if "day" not in keyed.columns:
        keyed = keyed.selectExpr("*", f"{day_of(log)} AS day")
    known = " AND ".join(f"{key} IS NOT NULL" for key in keys)
    return keyed.filter(known).groupBy(*keys).agg(*exprs(measures))


def daily_productivity(log: DataFrame) -> DataFrame:
    """Per day: tasks whose outcome is known."""
    return _daily(log, (), {"productivity": total("with_outcome")})


def daily_registered_updated(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per day: registered, updated and their sum."""
    return _daily(
        log,
        (),
        {
            "registered": tasks(equals("outcome", vocabulary.registered)),
            "updated": tasks(equals("outcome", vocabulary.updated)),
            "productivity": tasks(among("outcome", vocabulary.handled)),
        },
    )


def _daily_tmo(log: DataFrame, by: Sequence[str], kept: str, tmo_s: str) -> DataFrame:
    out = _daily(log.filter(kept), by, {"tmo_s": tmo_s})
    return out.selectExpr("*", f"{min_sec('tmo_s')} AS tmo_text")


def daily_tmo(
    log: DataFrame, by: Sequence[str] = (), vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Per day (and analyst): mean known duration of registered tasks."""
    return _daily_tmo(log, by, equals("outcome", vocabulary.registered), mean_s())


def daily_tmo_closed(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per day: time of finished and cancelled tasks over their number."""
    closed = among("status", (vocabulary.finished, vocabulary.cancelled))
    return _daily_tmo(log, (), closed, mean_s(per="with_status"))


def daily_tmo_closed_zero_filled(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """As ``daily_tmo_closed`` for the variant spelling of finished; never null."""
    closed = among("status", (vocabulary.finished_variant, vocabulary.cancelled))
    return _daily_tmo(log, (), closed, or_zero(mean_s(per="with_status")))


def daily_tmo_registered(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per day: time of registered tasks over their number (unknown counts as zero)."""
    return _daily_tmo(log, (), equals("outcome", vocabulary.registered), mean_s(per="n"))


TMO_KINDS = ("overall", "registered", "updated", "audited")


def monthly_means(
    log: DataFrame, overall: Sequence[str], by: Sequence[str], vocabulary: Vocabulary
) -> DataFrame:
    """Per month with an overall task: mean seconds overall and per outcome, in one pass."""
    kinds = {
        "overall": among("outcome", overall),
        "registered": equals("outcome", vocabulary.registered),
        "updated": equals("outcome", vocabulary.updated),
        "audited": equals("outcome", vocabulary.audited),
    }
    keys = (*by, "month")
    keyed = with_measures(log).selectExpr("*", f"{month_of(log)} AS month")
    means = (
        keyed.filter(" AND ".join(f"{key} IS NOT NULL" for key in keys))
        .groupBy(*keys)
        .agg(
            *exprs(
                {f"{kind}_tmo_s": mean_s(when) for kind, when in kinds.items()}
                | {"overall_n": tasks(kinds["overall"])}
            )
        )
        .filter("overall_n > 0")
    )
    return means.selectExpr(
        *by, f"{month_text('month')} AS month", *[f"{kind}_tmo_s" for kind in TMO_KINDS]
    )


def monthly_shown(means: DataFrame) -> DataFrame:
    """Monthly means with their text forms."""
    return means.selectExpr("*", *named({f"{k}_tmo": hms(f"{k}_tmo_s") for k in TMO_KINDS}))


def monthly_tmo_by_outcome(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per month: mean known duration overall (no audits), registered, updated, audited."""
    return monthly_shown(monthly_means(log, vocabulary.production, (), vocabulary))


def monthly_tmo_long(monthly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A monthly table with one row per month and kind, with the label a chart shows."""
    plain = monthly.selectExpr(*by, "month", *[f"{k}_tmo_s AS {k}" for k in TMO_KINDS])
    long = plain.unpivot([*by, "month"], list(TMO_KINDS), "kind", "tmo_s")
    return long.selectExpr("*", f"concat(initcap(kind), ' - ', {hms('tmo_s')}) AS label")


def monthly_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per month: mean known duration of the three outcomes, in minutes and as text."""
    production = log.filter(among("outcome", vocabulary.production))
    keyed = with_measures(production).selectExpr("*", f"{month_of(log)} AS month")
    means = keyed.filter("month IS NOT NULL").groupBy("month").agg(*exprs({"us": mean_us()}))
    return means.selectExpr(
        f"{month_text('month')} AS month",
        f"us / {60 * MICROS}D AS tmo_minutes",
        f"{hours_min_sec('us')} AS tmo_text",
    )


def analyst_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per analyst with closed tasks: time of the registered ones over their number."""
    closed = among("status", (vocabulary.finished, vocabulary.cancelled))
    kept = drop_doubt_outliers(
        with_measures(log).filter(f"analyst IS NOT NULL AND {closed}"), vocabulary
    )
    registered = equals("outcome", vocabulary.registered)
    out = kept.groupBy("analyst").agg(*exprs({"tmo_s": mean_s(registered, "n")}))
    return out.selectExpr("*", f"{hms('tmo_s')} AS tmo")


def deviation_counts(log: DataFrame) -> DataFrame:
    """How often each audit finding of the comma-separated lists occurs, most often first."""
    parts = log.filter("deviations IS NOT NULL").selectExpr(
        "explode(split(deviations, ',', -1)) AS part"
    )
    named_parts = parts.selectExpr(f"{strip('part')} AS deviation")
    counts = named_parts.groupBy("deviation").agg(*exprs({"frequency": "count(*)"}))
    return counts.orderBy(F.desc("frequency"), "deviation")


def deviation_counts_real(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """``deviation_counts`` without the word for no deviation, in any case."""
    word = text(vocabulary.no_deviation.lower())
    return deviation_counts(log).filter(f"lower(deviation) <> {word}")


def top_deviation(log: DataFrame) -> DataFrame:
    """The most frequent finding; the first by name among equals."""
    return deviation_counts(log).orderBy(F.desc("frequency"), "deviation").limit(1)
