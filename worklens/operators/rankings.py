"""Analyst rankings, quartile bands, best analyst per queue.

The windows run over aggregated rows, one per analyst, never over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.config import DEFAULT, Vocabulary
from worklens.functions.durations import hms
from worklens.functions.measures import (
    mean_s,
    mean_s_of,
    mean_us_of,
    tasks,
    totals,
    with_measures,
)
from worklens.functions.sql import among, equals, exprs, not_among, text
from worklens.operators.filters import Roster, filter_analysts

MANY_ANALYSTS = 12  # fixed value: with more, a band holds BAND_OF_MANY
BAND_OF_MANY = 4  # fixed value


def quartile_band(position: str, analysts: str) -> str:
    """Band 1 to 4 of a position among ``analysts``; with over 12, band 4 takes 13 onward."""
    size = f"IF({analysts} > {MANY_ANALYSTS}, {BAND_OF_MANY}L, ({analysts} + 3) div 4)"
    return f"least(4L, ({position} + {size} - 1) div {size})"


def with_positions(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Position by falling total (ties by name) and band, within each ``by`` group."""
    keys = f"PARTITION BY {', '.join(by)}" if by else ""
    placed = sums.selectExpr(
        "*",
        f"CAST(row_number() OVER ({keys} ORDER BY total DESC, analyst) AS BIGINT) AS position",
        f"count(*) OVER ({keys}) AS analysts",
    )
    return placed.selectExpr("*", f"{quartile_band('position', 'analysts')} AS band").drop(
        "analysts"
    )


def rank_overall(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Analysts by registered, distributed and updated tasks; zero totals stay."""
    counts = {
        "registered": tasks(equals("outcome", vocabulary.registered)),
        "distributed": tasks(equals("outcome", vocabulary.distributed)),
        "updated": tasks(equals("outcome", vocabulary.updated)),
        "total": tasks(among("outcome", vocabulary.production)),
    }
    sums = filter_analysts(with_measures(log), roster).groupBy("analyst").agg(*exprs(counts))
    return with_positions(sums).select("position", "analyst", *counts, "band")


def ranking_rules(vocabulary: Vocabulary = DEFAULT) -> Mapping[str, str]:
    """Which tasks count in each single-outcome ranking."""
    registered = equals("outcome", vocabulary.registered)
    updated = equals("outcome", vocabulary.updated)
    audited = equals("outcome", vocabulary.audited)
    distributed = equals("outcome", vocabulary.distributed)
    other = not_among("queue", vocabulary.registration_excluded_queues)
    early = among("queue", vocabulary.pre_registration_queues)
    return {
        "updates": updated,
        "registration": f"{registered} AND {other}",
        "pre_registration": f"{registered} AND {early}",
        "official_letters": f"{registered} AND {equals('queue', vocabulary.official_letter_queue)}",
        "agencies": f"{registered} AND {equals('queue', vocabulary.agency_queue)}",
        "audit": f"{audited} AND {equals('queue', vocabulary.audit_queue)}",
        "distribution": f"{distributed} AND {among('queue', vocabulary.distribution_queues)}",
    }


_RANK_COLUMNS = ("position", "analyst", "total", "tmo_s", "tmo", "band")


def _ranked(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = counted.groupBy(*by, "analyst").agg(*exprs({"total": tasks(), "tmo_s": mean_s()}))
    shown = sums.selectExpr("*", f"{hms('tmo_s')} AS tmo")
    return with_positions(shown, by).select(*by, *_RANK_COLUMNS)


def rank_by(
    log: DataFrame, ranking: str, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """Analysts by tasks of one ranking, with their mean known duration."""
    counted = with_measures(log).filter(ranking_rules(vocabulary)[ranking])
    return _ranked(filter_analysts(counted, roster))


def rank_updates(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    return rank_by(log, "updates", roster, vocabulary)


def rank_registration(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    return rank_by(log, "registration", roster, vocabulary)


def rank_pre_registration(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    return rank_by(log, "pre_registration", roster, vocabulary)


def rank_official_letters(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    return rank_by(log, "official_letters", roster, vocabulary)


def rank_agencies(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    return rank_by(log, "agencies", roster, vocabulary)


def rank_audit(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    return rank_by(log, "audit", roster, vocabulary)


def rank_distribution(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    return rank_by(log, "distribution", roster, vocabulary)


def all_rankings(
    log: DataFrame, roster: Roster = None, vocabulary: Vocabulary = DEFAULT
) -> DataFrame:
    """The single-outcome rankings together, from one scan.

    Tasks are first summed per (analyst, outcome, queue) and only those sums are
    copied into the rankings they count in.
    """
    sums = (
        filter_analysts(with_measures(log), roster)
        .groupBy("analyst", "outcome", "queue")
        .agg(*exprs(totals()))
    )
    names = ", ".join(
        f"IF({rule}, '{name}', NULL)" for name, rule in ranking_rules(vocabulary).items()
    )
    return _ranked(
        sums.selectExpr("*", f"explode(array_compact(array({names}))) AS ranking"), ["ranking"]
    )


def _handled_per_queue(log: DataFrame, keep: str, vocabulary: Vocabulary) -> DataFrame:
    """Sums per queue and analyst of handled work, without external analysts."""
    handled = with_measures(log).filter(
        f"{among('outcome', vocabulary.handled)} AND queue IS NOT NULL AND analyst IS NOT NULL"
        f" AND NOT contains(analyst, {text(vocabulary.external_marker)}) AND {keep}"
    )
    return handled.groupBy("queue", "analyst").agg(*exprs(totals()))


def _best(per_queue: DataFrame, order: str) -> DataFrame:
    place = f"row_number() OVER (PARTITION BY queue ORDER BY {order}, analyst) AS place"
    return per_queue.selectExpr("*", place).filter("place = 1")


def best_by_queue_tmo(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per queue: the analyst with the lowest mean; first by name among equals.

    A queue without any known duration has no best analyst.
    """
    excluded = vocabulary.best_excluded
    keep = "true" if excluded is None else f"analyst <> {text(excluded)}"
    sums = ("dur_s", "dur_us", "timed")
    means = (
        _handled_per_queue(log, keep, vocabulary)
        .filter("timed > 0")
        .selectExpr("*", f"{mean_us_of(*sums)} AS mean_us")
    )
    return _best(means, "mean_us").selectExpr(
        "queue", "analyst", f"{hms(mean_s_of(*sums))} AS tmo", "timed AS tasks"
    )


def best_by_queue_volume(log: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per queue: the analyst with the most tasks; first by name among equals."""
    excluded = vocabulary.best_excluded
    keep = "true" if excluded is None else f"NOT contains(analyst, {text(excluded)})"
    counts = _handled_per_queue(log, keep, vocabulary)
    return _best(counts, "n DESC").selectExpr("queue", "analyst", "n AS tasks")


def most_productive(log: DataFrame) -> DataFrame:
    """The analyst with the most tasks; first by name among equals."""
    named = with_measures(log).filter("analyst IS NOT NULL")
    counts = named.groupBy("analyst").agg(*exprs({"tasks": tasks()}))
    return counts.orderBy(F.desc("tasks"), "analyst").limit(1)
