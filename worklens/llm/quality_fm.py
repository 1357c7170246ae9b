"""Quality scores by a factorisation machine.

A document's features are its hashed words, its structure (rates and sizes, in bins) and
its length as the metadata state it. Every pair of features interacts through the product
of their low-rank vectors; the sum over all pairs is half of the square of the sum less
the sum of the squares, so a score takes time linear in the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.training import Adam, held_out, labelled_sample, sigmoid

_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_DIGITS = bytes(set(range(256)) - set(range(48, 58)))
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_MARKS = bytes(set(range(256)) - set(b"!?.,;:"))
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Bins per structure statistic.
BINS = 24
STATISTICS = 11


@dataclass(frozen=True)
class FactorSettings:
    """``sample_rows`` and ``sample_chars`` bound what is learnt from: at most so many labelled
    documents of at most so many characters. The rest shapes the model and its fit."""

    sample_rows: int = 6000
    sample_chars: int = 100_000
    word_buckets: int = 1 << 14
    rank: int = 4
    epochs: int = 60
    rate: float = 0.03
    shrink: float = 1e-3
    threshold: float = 0.7


def structure(text: bytes, words: list[bytes], distinct: int, stated: float | None) -> list[int]:
    """The bin of each statistic: sizes by powers of two, rates by their size in tenths
    and finer towards zero."""
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    letters = len(text.translate(None, _SPACE + _CONTINUATION))

    def rate(part: int, whole: int) -> int:
        r = part / max(whole, 1)
        return 0 if r <= 0 else int(np.clip(np.log2(r) * 2 + 14, 1, BINS - 1))

    def level(x: float) -> int:
        return int(np.clip(np.log2(x + 1), 0, BINS - 1))

    return [
        level(len(words)),
        level(len(lines)),
        int(np.clip(2 * letters / n, 0, BINS - 1)),
        rate(len(text.translate(None, _SYMBOLS)), n),
        rate(len(text.translate(None, _UPPER)), size),
        rate(len(text.translate(None, _DIGITS)), size),
        rate(len(text.translate(None, _MARKS)), n),
        rate(text.count(b"!"), n),
        rate(len(words) - distinct, len(words)),
        rate(len(lines) - len(set(lines)), len(lines)),
        BINS - 1 if stated is None or stated != stated or stated < 0 else min(level(stated), BINS - 2),
    ]


def features(
    texts: list[bytes | None], stated: list[float | None], buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of each text one after another, and how many each has."""
    ids, values, counts = [], [], []
    digest = xxhash.xxh32_intdigest
    for text, meta in zip(texts, stated):
        text = text or b""
        words = text.split()
        distinct = set(words)
        hashed = np.unique(
            np.fromiter((digest(w) % buckets for w in distinct), np.int64, len(distinct))
        )
        bins = structure(text, words, len(distinct), meta)
        own = buckets + np.arange(STATISTICS) * BINS + np.array(bins)
        ids += [hashed, own]
        values += [
            np.full(len(hashed), 1 / np.sqrt(max(len(hashed), 1)), np.float32),
            np.full(STATISTICS, 0.3, np.float32),
        ]
        counts.append(len(hashed) + STATISTICS)
    if not counts:
        return np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64)
    return np.concatenate(ids), np.concatenate(values), np.array(counts)


def raw_scores(model: dict, ids: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple:
    """Scores before the sigmoid, and the sums that gradients need. Every text has features."""
    starts = np.cumsum(counts) - counts
    terms = model["v"][ids] * values[:, None]
    sums = np.add.reduceat(terms, starts)
    squares = np.add.reduceat(terms**2, starts)
    linear = np.add.reduceat(model["w"][ids] * values, starts)
    return model["w0"] + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, terms


def fit(
    ids: np.ndarray, values: np.ndarray, counts: np.ndarray, y: np.ndarray, settings: FactorSettings
) -> dict:
    """The model by full-batch Adam on the logistic loss. Without labels of both kinds it
    scores their mean (without any, one half)."""
    size = settings.word_buckets + STATISTICS * BINS
    random = np.random.default_rng(7)
    mean = float(y.mean()) if len(y) else 0.5
    labelled = len(y) > 0 and 0 < mean < 1
    model = {
        "w0": np.array([np.log((mean + 1e-3) / (1 - mean + 1e-3))]),
        "w": np.zeros(size),
        "v": random.normal(0, 0.05, (size, settings.rank)),
    }
    if not labelled:
        model["v"][:] = 0
    else:
        adam = Adam(settings.rate)
        doc = np.repeat(np.arange(len(counts)), counts)
        for adam.step in range(1, settings.epochs + 1):
            z, sums, terms = raw_scores(model, ids, values, counts)
            g = (sigmoid(z) - y) / len(y)
            each = g[doc] * values
            pull = {"w0": np.array([g.sum()]), "w": np.bincount(ids, each, size)}
            cross = each[:, None] * (sums[doc] - terms)
            pull["v"] = np.stack(
                [np.bincount(ids, cross[:, f], size) for f in range(settings.rank)], axis=1
            )
            for name in ("w", "v"):
                pull[name] += settings.shrink * model[name] / len(y) ** 0.5
            for name, gradient in pull.items():
                adam.update(name, model[name], gradient)
    return {name: value.astype(np.float32) for name, value in model.items()}


def _prepared(docs: DataFrame, id_column: str, text_column: str, meta_column: str) -> DataFrame:
    meta = F.col(f"`{meta_column}`").cast("double") if meta_column in docs.columns else F.lit(None)
    return docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
        meta.cast("double").alias("meta"),
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    settings: FactorSettings = FactorSettings(),
    label: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    meta_column: str = "n_chars",
) -> dict:
    """A model learnt from a bounded sample of labelled documents; features are taken
    where the documents are, and at most all word buckets of each reach the driver."""
    sample = labelled_sample(
        _prepared(docs, id_column, text_column, meta_column),
        labels.withColumnRenamed(id_column, "id"),
        label,
        settings.sample_rows,
        settings.sample_chars,
        "id",
    )
    buckets = settings.word_buckets

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, counts = features(
                batch.column("text").to_pylist(), batch.column("meta").to_pylist(), buckets
            )
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32())),
                    batch.column("y"),
                    batch.column("id").cast(pa.string()),
                ],
                names=["ids", "values", "y", "id"],
            )

    rows = (
        sample.withColumn("text", F.col("text").cast("binary"))
        .mapInArrow(extract, "ids array<int>, values array<float>, y double, id string")
        .toArrow()
        .sort_by("id")
        .combine_chunks()
    )
    if not rows.num_rows:
        none, whole = np.empty(0), np.empty(0, np.int64)
        return fit(whole, none, whole, none, settings)
    lists = rows.column("ids").combine_chunks()
    return fit(
        lists.flatten().to_numpy().astype(np.int64),
        rows.column("values").combine_chunks().flatten().to_numpy().astype(np.float64),
        lists.value_lengths().to_numpy().astype(np.int64),
        rows.column("y").to_numpy(),
        settings,
    )


def score(
    docs: DataFrame,
    model: dict,
    settings: FactorSettings = FactorSettings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    meta_column: str = "n_chars",
) -> DataFrame:
    """Each row's id, ``held_out``, ``score`` (0 to 1) and ``predicted``, from its whole text.

    A null text counts as empty and is scored by its structure; a null or negative stated
    length is a bin of its own. Repeated rows get the same score.
    """
    # As many numbers as buckets and bins times the rank: a fixed size.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    buckets = settings.word_buckets

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, meta in batches:
            out = []
            for at in range(0, len(texts), 256):
                ids, values, counts = features(
                    list(texts[at : at + 256]), list(meta[at : at + 256]), buckets
                )
                out.append(sigmoid(raw_scores(shared.value, ids, values, counts)[0]))
            yield pd.Series(np.concatenate(out) if out else np.empty(0), dtype=np.float64)

    scored = _prepared(docs, id_column, text_column, meta_column).select(
        "id", scores(F.col("text").cast("binary"), F.col("meta")).alias("score")
    )
    return scored.selectExpr(
        f"id AS `{id_column}`",
        f"{held_out('id')} AS held_out",
        "score",
        f"CAST(score >= {settings.threshold}D AS INT) AS predicted",
    )
