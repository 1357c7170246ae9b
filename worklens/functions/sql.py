"""Small pieces of SQL text.

Operators write their columns as SQL text, one call per list of columns, rather
than building each from dozens of Column calls: the plan is the same, and
making it takes a few milliseconds in place of a second.

A missing value equals nothing and differs from everything, so ``differs`` and
``not_among`` are true for it; ``=`` and ``among`` only ever select.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_of(columns: Iterable[str]) -> str:
    """The order of a log's rows as one number: by batch, where it has batches, then ``seq``.

    A DECIMAL(38, 0) holds both whatever their size, and keeps an aggregation's buffer
    of fixed width.
    """
    if "batch" not in columns:
        return "seq"
    return "CAST(batch * 10000000000000000000BD + seq AS DECIMAL(38, 0))"


def text(value: str) -> str:
    """A text literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def among(column: str, values: Iterable[str]) -> str:
    listed = ", ".join(text(v) for v in values)
    return f"({column} IN ({listed}))" if listed else "false"


def not_among(column: str, values: Iterable[str]) -> str:
    return f"({column} IS NULL OR NOT {among(column, values)})"


def equals(column: str, value: str) -> str:
    return f"({column} = {text(value)})"


def differs(column: str, value: str) -> str:
    return f"(NOT {column} <=> {text(value)})"


def named(columns: Mapping[str, str]) -> list[str]:
    """Columns for ``selectExpr`` from name -> text."""
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def exprs(columns: Mapping[str, str]) -> list[Column]:
    """Columns for ``agg`` from name -> text."""
    return [F.expr(sql) for sql in named(columns)]
