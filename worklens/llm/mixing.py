"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed to cells of source, language and topic. The cells' token weights
are scaled to each margin's target in turn, in a fixed number of sweeps, and each document is
then kept with its cell's calibrated probability. Only cells are raked, so the work
after one aggregation does not depend on the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.tables import kept

MARGINS = ("source", "lang", "topic")
#: A topic and the words (a regular expression) that stand for it; fixed values.
TOPICS = {
    "licence": r"(?i)licen[cs]e|copyright|all rights reserved",
    "contact": r"@|https?://|www\.",
    "figures": r"[0-9]+",
}


@dataclass(frozen=True)
class Mix:
    """Target shares of tokens. A margin without given shares takes its observed shares
    to the power of its ``temper`` (1 keeps them, 0 makes them equal), normalised.
    Given shares are normalised over the values that occur; a value without a share
    takes none. ``keep`` is the share of all tokens to keep."""

    keep: float = 0.5
    temper: Mapping[str, float] = field(
        default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.7}
    )
    shares: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    sweeps: int = 10
    fills: int = 6
    seed: str = "mix"


def with_cell(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` as one struct ``row`` with ``source, lang, topic`` and ``tokens``.

    Tokens are runs of characters other than ASCII white space. The topic is the column
    ``topic`` where ``docs`` has one, else the topic whose words occur most (ties: the
    first by name), or ``general`` where none occurs.
    """
    text = f"coalesce(row.`{text_column}`, '')"
    tokens = (
        f"CAST(regexp_count(concat(' ', {text}), '[\\\\x20\\\\x09-\\\\x0D][^\\\\x20\\\\x09-\\\\x0D]')"
        " AS BIGINT) AS tokens"
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if "topic" in docs.columns:
        topic = "coalesce(CAST(row.topic AS STRING), '') AS topic"
    else:
        counts = {
            name: f"regexp_count({text}, '{pattern.replace(chr(92), chr(92) * 2)}')"
            for name, pattern in sorted(TOPICS.items())
        }
        rows = rows.selectExpr("row", *[f"{sql} AS {name}" for name, sql in counts.items()])
        cases = " ".join(
            f"WHEN {name} > 0 AND {name} >= greatest({', '.join(counts)}) THEN '{name}'"
            for name in counts
        )
        topic = f"CASE {cases} ELSE 'general' END AS topic"
    keys = [
        f"coalesce(CAST(row.`{c}` AS STRING), '') AS {c}" if c in docs.columns else f"'' AS {c}"
        for c in ("source", "lang")
    ]
    return rows.selectExpr("row", *keys, topic, tokens)


def cell_rates(cells: DataFrame, mix: Mix) -> DataFrame:
    """Adds to cells ``source, lang, topic, tokens`` their raked share ``weight`` and the
    probability ``p`` that keeps one of their documents.

    A cell without tokens weighs nothing and is kept with probability ``keep``. Where a
    cell would need more tokens than it has, all its documents stay and the others make
    up for it.
    """
    total = "sum(tokens) OVER ()"
    state = cells.selectExpr("*", f"coalesce(tokens / nullif({total}, 0), 0D) AS observed")
    state = state.withColumn("weight", F.col("observed"))
    for margin in MARGINS:
        own = f"sum(observed) OVER (PARTITION BY {margin})"
        if margin in mix.shares:
            given = " ".join(
                f"WHEN '{value}' THEN {share!r}D" for value, share in sorted(mix.shares[margin].items())
            )
            raw = f"CASE {margin} {given} ELSE 0D END"
        else:
            raw = f"power({own}, {float(mix.temper[margin])!r}D)"
        state = state.selectExpr("*", f"{raw} AS raw", f"{own} AS own")
        # Each value of the margin counts once: its cells' parts of it add up to one.
        state = state.selectExpr(
            "* EXCEPT (raw, own)",
            f"coalesce(raw / nullif(sum(raw * observed / nullif(own, 0)) OVER (), 0), 0D)"
            f" AS to_{margin}",
        )
    for sweep in range(mix.sweeps):
        for margin in MARGINS:
            state = state.withColumn(
                "weight",
                F.expr(
                    f"coalesce(weight * to_{margin}"
                    f" / nullif(sum(weight) OVER (PARTITION BY {margin}), 0), 0D)"
                ),
            )
        if sweep % 5 == 4:
            state = kept(state, "raked")
    state = state.selectExpr("*", f"{mix.keep!r}D AS level")
    ratio = "coalesce(weight / nullif(observed, 0), 1D)"
    for _ in range(mix.fills):
        # Where the level meets the budget, given the cells that are full at this level.
        full = f"level * {ratio} >= 1"
        state = state.withColumn(
            "level",
            F.expr(
                f"greatest(level, coalesce(({mix.keep!r}D"
                f" - sum(CASE WHEN {full} THEN observed ELSE 0D END) OVER ())"
                f" / nullif(sum(CASE WHEN {full} THEN 0D ELSE weight END) OVER (), 0), level))"
            ),
        )
    return state.selectExpr(
        *MARGINS,
        "tokens",
        "weight",
        f"CASE WHEN observed = 0 THEN {mix.keep!r}D"
        f" ELSE round(least(1D, level * {ratio}), 9) END AS p",
    )


def mixed(
    docs: DataFrame, mix: Mix = Mix(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every document as ``row`` with its cell, ``tokens``, ``weight``, ``p`` and ``kept``.

    The draw is a hash of the id (null: empty text) and the seed, so it is the same on
    every run; repeated ids are drawn alike. A null source or language is the empty one.
    """
    celled = with_cell(docs, text_column)
    cells = celled.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    rates = kept(cell_rates(kept(cells, "cells"), mix), "rates").withColumnsRenamed(
        {c: f"r_{c}" for c in (*MARGINS, "tokens")}
    )
    draw = (
        "CAST(conv(left(md5(concat("
        f"'{mix.seed}:', coalesce(CAST(row.`{id_column}` AS STRING), ''))), 8), 16, 10) AS BIGINT)"
        " / 4294967296D"
    )
    on = " AND ".join(f"{c} = r_{c}" for c in MARGINS)
    return celled.join(rates, F.expr(on)).selectExpr(
        "row", *MARGINS, "tokens", "weight", "p", f"{draw} < p AS kept"
    )


def sample_to_mix(
    docs: DataFrame, mix: Mix = Mix(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents that :func:`mixed` keeps, with their own columns only."""
    return mixed(docs, mix, id_column, text_column).where("kept").select("row.*")
