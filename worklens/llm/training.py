"""A bounded, reproducible sample of labelled documents, and an optimiser for small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.tables import id_crc

#: Rows whose crc32 of the id leaves this remainder are never learnt from.
FOLDS, HELD_OUT = 4, 2


def held_out(id_column: str) -> str:
    """SQL: whether a row is held out of training."""
    return f"{id_crc(f'`{id_column}`')} % {FOLDS} = {HELD_OUT}"


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, id_column: str = "doc_id"
) -> DataFrame:
    """``docs`` with a column ``y`` for at most ``rows`` labelled documents outside the held-out
    fold, each of at most ``chars`` characters, the same ones on every run.

    Labels other than 0 and 1 count as none; of several labels of an id the least counts.
    """
    known = labels.where(f"`{label}` IN (0, 1) AND `{id_column}` IS NOT NULL").where(
        f"NOT ({held_out(id_column)})"
    )
    chosen = (
        known.groupBy(F.col(f"`{id_column}`").alias("y_id"))
        .agg(F.min(f"`{label}`").cast("double").alias("y"))
        .orderBy(F.xxhash64("y_id"), "y_id")
        .limit(rows)
    )
    short = docs.where(f"char_length(text) <= {chars}")
    # At most ``rows`` pairs of numbers: a proven bound.
    return short.join(F.broadcast(chosen), F.col(f"`{id_column}`") == F.col("y_id")).drop("y_id")


class Adam:
    """Steps along gradients scaled by their own running size."""

    def __init__(self, rate: float) -> None:
        self.rate, self.step, self.state = rate, 0, {}

    def update(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        t = self.step
        value -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
