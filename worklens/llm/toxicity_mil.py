"""Toxicity by multiple-instance learning.

Only documents carry labels. Each sentence gets a probability from its words, and a
document is toxic unless none of its sentences is: the noisy-or of the sentences. The
gradient of the document's loss flows to its sentences, so the model learns which of
them offend and can point at them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.pieces import Numbering, Ragged
from worklens.llm.training import Adam, held_out, labelled_sample, sigmoid

_TRIM = b".,;:!?\"'()[]{}*#$%&|<>-_"
_LINE = b"\x00"


@dataclass(frozen=True)
class InstanceSettings:
    """``sample_rows`` and ``sample_chars`` bound what is learnt from: at most so many labelled
    documents of at most so many characters. ``least_docs``: documents of the sample
    that a feature must occur in. ``offends``: the probability from which a sentence is named."""

    sample_rows: int = 6000
    sample_chars: int = 100_000
    buckets: int = 1 << 21
    least_docs: int = 5
    epochs: int = 60
    rate: float = 0.15
    shrink: float = 1e-3
    threshold: float = 0.3
    offends: float = 0.3


def tokens(text: bytes | None) -> list[bytes]:
    """Words and, between lines, a zero byte."""
    return (text or b"").replace(_LINE, b" ").replace(b"\n", b" \x00 ").split()


def word_features(word: bytes, buckets: int) -> list[int]:
    """Buckets of a word, lower-cased and trimmed, and of its beginnings."""
    word = word.lower().strip(_TRIM)
    if not word:
        return []
    parts = [b"=" + word] + [b"%d" % n + word[:n] for n in (4, 5, 6, 7) if len(word) > n]
    return [xxhash.xxh32_intdigest(p) % buckets for p in parts]


def instances(row: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sentence and token of each distinct token of each sentence, and how many sentences
    there are. An ending token is its sentence's last, and so is one before a line's end,
    which is token 0 and belongs to no sentence."""
    last = ends[row] | (np.append(row[1:], -1) == 0)
    last, row = last[row != 0].astype(np.int64), row[row != 0]
    if not len(row):
        return row, row, 1
    number = np.cumsum(last) - last
    n, width = int(number[-1]) + 1, int(row.max()) + 1
    code = np.unique(number * width + row)
    return code // width, code % width, n


class Words(Numbering):
    """Distinct tokens with whether each ends a sentence; token 0 is the end of a line."""

    def __init__(self) -> None:
        super().__init__()
        self.of([_LINE])
        self.ends = np.empty(0, bool)

    def learn(self) -> list[bytes]:
        new = self.take_new()
        ends = [w.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?") for w in new]
        self.ends = np.concatenate((self.ends, np.array(ends, bool)))
        return new


def fit(texts: list[bytes], y: np.ndarray, settings: InstanceSettings) -> dict:
    """Weights of the features and the bias. Without labels of both kinds every sentence
    scores alike: as few labels as there are toxic ones, nothing else is known."""
    mean = float(y.mean()) if len(y) else 0.0
    full = np.zeros(settings.buckets, np.float32)
    if not 0 < mean < 1:
        return {"weight": full, "bias": 9.0 if mean else -9.0}
    words = Words()
    rows = [words.of(tokens(t)).astype(np.int32) for t in texts]
    features = Ragged()
    flat, sizes = array("i"), array("i")
    for word in words.learn():
        of_word = word_features(word, settings.buckets)
        flat.extend(of_word)
        sizes.append(len(of_word))
    features.append(np.array(sizes, np.int64), np.array(flat, np.int32))
    ends = words.ends
    del words, flat
    # Toxic and other documents of each feature.
    seen = np.zeros((2, settings.buckets), np.float32)
    for toxic, row in zip(y > 0.5, rows):
        seen[0 if toxic else 1, np.unique(features.gather(np.unique(row))[1])] += 1
    usual = np.flatnonzero(seen.sum(axis=0) >= settings.least_docs)
    seen = seen[:, usual]
    # Only words with such a feature matter; these and the features get numbers of their own.
    number = np.full(settings.buckets, -1, np.int32)
    number[usual] = np.arange(len(usual), dtype=np.int32)
    feature = number[features.flat]
    word_of = np.repeat(np.arange(len(features.lengths)), features.lengths)[feature >= 0]
    feature = feature[feature >= 0]
    matters = np.unique(word_of)
    word_of = np.searchsorted(matters, word_of)
    renamed = np.full(len(features.lengths), -1, np.int32)
    renamed[matters] = np.arange(len(matters), dtype=np.int32)
    sentences, sentence_doc, in_sentence = [], [], []
    total = 0
    for d, row in enumerate(rows):
        sentence, word, n = instances(row, ends)
        word = renamed[word]
        sentences.append((sentence[word >= 0] + total).astype(np.int32))
        in_sentence.append(word[word >= 0])
        sentence_doc.append(np.full(n, d, np.int32))
        total += n
    sentence, doc, word = map(np.concatenate, (sentences, sentence_doc, in_sentence))
    del rows, features, sentences, in_sentence
    # The noisy-or stops pulling once a document is explained, so weights begin at the
    # cautious log-odds of their documents rather than at zero.
    share = (seen[0] - np.sqrt(seen[0])).clip(0.1) / y.sum()
    other = (seen[1] + np.sqrt(seen[1]) + 0.5) / (len(y) - y.sum())
    weight = np.maximum(np.log(share / other), 0).astype(np.float64)
    bias, adam = np.array([-6.0]), Adam(settings.rate)
    for adam.step in range(1, settings.epochs + 1):
        of_word = np.bincount(word_of, weight[feature], len(matters))
        p = sigmoid(bias[0] + np.bincount(sentence, of_word[word], total))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        # From log(1 - P) = sum of log(1 - p): each sentence's share of the gradient.
        odds = np.exp(none) / np.maximum(-np.expm1(none), 1e-9)
        g = p * np.where(y > 0.5, -odds, 1.0)[doc] / len(y)
        on_word = np.bincount(word, g[sentence], len(matters))
        adam.update("bias", bias, np.array([g.sum()]))
        adam.update("weight", weight, np.bincount(feature, on_word[word_of], len(usual)))
        # Evidence only: a word never excuses the others of its sentence.
        weight -= settings.shrink
        np.maximum(weight, 0, out=weight)
    full[usual] = weight
    return {"weight": full, "bias": float(bias[0])}


class Scorer:
    """Sentence probabilities of whole texts; each distinct word is weighed once."""

    KEPT_WORDS = 1 << 19

    def __init__(self, model: dict, buckets: int) -> None:
        self.model, self.buckets = model, buckets
        self.words, self.weights = Words(), np.empty(0)

    def sentences(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each text the probability of each sentence, in order; one for a text without words."""
        if len(self.words) > self.KEPT_WORDS:
            self.words, self.weights = Words(), np.empty(0)
        rows = [self.words.of(tokens(text)) for text in texts]
        weight = self.model["weight"]
        more = [float(weight[word_features(w, self.buckets)].sum()) for w in self.words.learn()]
        self.weights = np.concatenate((self.weights, more))
        out = []
        for row in rows:
            number, row, n = instances(row, self.words.ends)
            out.append(sigmoid(self.model["bias"] + np.bincount(number, self.weights[row], n)))
        return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    settings: InstanceSettings = InstanceSettings(),
    label: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> dict:
    """A model learnt from a bounded sample of labelled documents."""
    source = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )
    sample = labelled_sample(
        source, labels.withColumnRenamed(id_column, "id"), label,
        settings.sample_rows, settings.sample_chars, "id",
    )
    rows = (
        sample.selectExpr("CAST(id AS STRING) AS id", "CAST(text AS BINARY) AS text", "y")
        .toArrow()
        .sort_by("id")
    )
    return fit(rows.column("text").to_pylist(), rows.column("y").to_numpy(), settings)


def score(
    docs: DataFrame,
    model: dict,
    settings: InstanceSettings = InstanceSettings(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Each row's id, ``held_out``, ``score``, ``predicted``, the number of ``sentences``, those
    that ``offend`` (their numbers from zero) and the ``worst`` one's probability.

    A sentence ends with a word that ends in a full stop, exclamation or question mark,
    or with its line. A null or empty text is one sentence without words.
    """
    # One number per bucket: a fixed size.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, sentences int, offend array<int>, worst double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value, settings.buckets)
        for texts in batches:
            rows = []
            for at in range(0, len(texts), 256):
                for p in scorer.sentences(list(texts[at : at + 256])):
                    total = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
                    offend = np.flatnonzero(p >= settings.offends)
                    rows.append((float(total), len(p), offend, float(p.max())))
            yield pd.DataFrame(rows, columns=["score", "sentences", "offend", "worst"])

    scored = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        scores(F.col(f"`{text_column}`").cast("string").cast("binary")).alias("s"),
    )
    return scored.selectExpr(
        f"id AS `{id_column}`",
        f"{held_out('id')} AS held_out",
        "s.score AS score",
        f"CAST(s.score >= {settings.threshold}D AS INT) AS predicted",
        "s.sentences AS sentences",
        "s.offend AS offend",
        "s.worst AS worst",
    )
