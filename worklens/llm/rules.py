"""Quality rules whose thresholds adapt to each language and source.

Every metric is a whole number per document. A quantile sketch is a count per bin:
values below 64 have a bin each, larger ones share 32 bins per power of two, so a
quantile is off by 1/32 of its value at most. Bins merge by adding, which makes a
source's sketch, a language's and the corpus's from one pass, the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.llm.tables import give_back, kept

METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: SQL of the rated metrics, in thousandths (of a code point for the mean word length).
RATES = {
    "symbols": "1000 * n_symbols DIV greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines DIV greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words DIV greatest(n_words, 1)",
    "word_length": "1000 * word_chars DIV greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Limit:
    """A value is rejected that lies beyond a group's upper quantile (in thousandths) by more
    than ``reach`` times the quantile's distance from the median, which counts as one bin of the
    sketch at least; if ``two_sided``, likewise below the quantile as far from the other end."""

    quantile: int
    reach: int
    two_sided: bool = False


#: Metrics that few texts have at all take a quantile from their tail.
LIMITS = {
    "symbols": Limit(900, 3),
    "dup_lines": Limit(980, 2),
    "repeats": Limit(980, 2),
    "word_length": Limit(900, 6, two_sided=True),
}


@dataclass(frozen=True)
class AdaptiveRules:
    """The limits of each group come from its own quantiles alone; documents that fail the base
    rules, and so go anyway, are not counted. A source with under ``min_docs`` documents of a
    language takes the language's sketch, a language with fewer takes the corpus's."""

    min_docs: int = 100
    limits: Mapping[str, Limit] = field(default_factory=lambda: LIMITS)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    size = len(number)
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in METRICS]))
def text_metrics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The base metrics of each text, given as UTF-8 bytes."""
    for texts in batches:
        yield _metrics_of(texts)
        del texts
    give_back()


def _metrics_of(texts: pd.Series) -> pd.DataFrame:
    space, symbols, continuation = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))
    others = bytes(set(range(256)) - set(symbols))
    rows = []
    for text in texts:
        text = text or b""
        words = text.split()
        lines = [line for line in text.split(b"\n") if line.strip(space)]
        rows.append(
            (
                len(words),
                len(text.translate(None, space + continuation)),
                len(text.translate(None, others)),
                len(lines),
                len(lines) - len(set(lines)),
                repeat_words(words),
            )
        )
    return pd.DataFrame(rows, columns=METRICS)


def with_metrics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` as one struct ``row``, its base metrics, ``lang`` and ``source``."""
    group = [
        (F.col(f"row.`{c}`") if c in docs.columns else F.lit(None)).cast("string").alias(c)
        for c in ("lang", "source")
    ]
    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", *group, text_metrics(F.col(f"row.`{text_column}`").cast("binary")).alias("m")
    )
    return measured.select("row", "lang", "source", "m.*").withColumn(
        "base_failed", F.expr(BASE_FAILED)
    )


def sketches(measured: DataFrame) -> DataFrame:
    """Counts ``n`` per ``lang, source, metric, bin`` of the documents that pass the base rules; a
    bin is named by its least value."""
    pairs = ", ".join(f"'{name}', {sql}" for name, sql in RATES.items())
    values = measured.where(f"NOT ({BASE_FAILED})").selectExpr("lang", "source", f"stack({len(RATES)}, {pairs}) AS (metric, v)")
    shift = "greatest(length(bin(v)) - 6, 0)"
    return (
        values.selectExpr(
            "lang", "source", "metric", f"shiftleft(shiftright(v, {shift}), {shift}) AS bin"
        )
        .groupBy("lang", "source", "metric", "bin")
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, rules: AdaptiveRules) -> DataFrame:
    """``low`` and ``high`` of every metric, as columns per ``lang`` and ``source``."""

    def share(of: str) -> str:
        cases = " ".join(f"WHEN '{m}' THEN {of.format(x.quantile)}" for m, x in rules.limits.items())
        return f"CASE metric {cases} END"

    ranks = {"low": share("1000 - {}"), "mid": "500", "high": share("{}")}

    def quantiles(merged: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        """The quantiles of each merged sketch, by a running sum over its bins."""
        over = ", ".join([*keys, "metric"])
        return (
            merged.selectExpr(
                *keys,
                "metric",
                "bin",
                f"sum(n) OVER (PARTITION BY {over} ORDER BY bin) AS upto",
                f"sum(n) OVER (PARTITION BY {over}) AS total",
            )
            .groupBy(*keys, "metric")
            .agg(
                *[
                    F.expr(f"min(bin) FILTER (WHERE 1000 * upto >= {rank} * total)").alias(
                        f"{prefix}_{name}"
                    )
                    for name, rank in ranks.items()
                ],
                F.max("total").alias(f"{prefix}_n"),
            )
        )

    by_lang = sketch.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    own = quantiles(sketch, ["lang", "source"], "s")
    lang = quantiles(by_lang, ["lang"], "l").withColumnsRenamed({"lang": "l_lang", "metric": "l_metric"})
    whole = quantiles(by_all, [], "a").withColumnRenamed("metric", "a_metric")
    chosen = own.join(lang, F.expr("lang <=> l_lang AND metric = l_metric")).join(
        whole, F.expr("metric = a_metric")
    )
    least = rules.min_docs
    chosen = chosen.selectExpr(
        "lang",
        "source",
        "metric",
        *[
            f"CASE WHEN s_n >= {least} THEN s_{q} WHEN l_n >= {least} THEN l_{q} ELSE a_{q} END AS {q}"
            for q in ranks
        ],
    )
    columns = []
    bin_width = "shiftleft(1L, greatest(length(bin({0})) - 6, 0))"
    for metric, limit in rules.limits.items():
        low = f"low - {limit.reach} * greatest(mid - low, {bin_width.format('mid')})"
        low = low if limit.two_sided else "-1L"
        high = f"high + {limit.reach} * greatest(high - mid, {bin_width.format('high')})"
        columns += [
            F.expr(f"max({low}) FILTER (WHERE metric = '{metric}')").alias(f"{metric}_low"),
            F.expr(f"max({high}) FILTER (WHERE metric = '{metric}')").alias(f"{metric}_high"),
        ]
    return chosen.groupBy(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source")
    ).agg(*columns)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds the limits of its group to each row, and ``kept``."""
    inside = " AND ".join(
        f"{sql} BETWEEN {name}_low AND {name}_high" for name, sql in RATES.items()
    )
    return measured.join(
        limits, F.expr("lang <=> t_lang AND source <=> t_source"), "left"
    ).withColumn("kept", F.expr(f"NOT base_failed AND coalesce({inside}, true)"))


def quality_verdicts(
    docs: DataFrame,
    rules: AdaptiveRules = AdaptiveRules(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: id, base metrics, ``base_failed``, ``kept`` and its limits.

    A null text has no words and fails the base; where all texts of a group fail it, the group
    has no limits. A null language or source is a group
    of its own. Repeated rows are judged one by one. An empty table gives no rows.
    """
    measured = with_metrics(docs, text_column).selectExpr(
        f"row.`{id_column}` AS id", "* EXCEPT (row)"
    )
    measured = kept(measured, "metrics")
    limits = thresholds(sketches(measured), rules)
    return judged(measured, limits).withColumnRenamed("id", id_column).drop("t_lang", "t_source")


def keep_by_quality(
    docs: DataFrame, rules: AdaptiveRules = AdaptiveRules(), text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged; texts are never shuffled."""
    measured = with_metrics(docs, text_column)
    limits = kept(thresholds(sketches(measured), rules), "limits")
    return judged(measured, limits).where("kept").select("row.*")
