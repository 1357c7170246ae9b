"""Readers: the stored task log, uploaded exports, unavailability lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.config import DEFAULT, Vocabulary
from worklens.functions.calendar import parse_interval_time
from worklens.operators.cleaning import (
    ADJUSTMENTS,
    adjustments_of,
    rename_headers,
    standardise_task_log,
)
from worklens.schema import UNAVAILABILITY_TEXT
from worklens.sources.store import STORED_LOG, scan_log, snapshot
from worklens.sources.uploads import COMMA, CsvDialect, files_at, scan_uploads
__all__ = [
    "STORED_LOG", "scan_adjustments", "scan_export", "scan_last_days", "scan_legacy_log",
    "scan_task_log", "scan_unavailability",
]


def scan_task_log(
    spark: SparkSession,
    root: str,
    extra: T.StructType | None = None,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> DataFrame:
    """The stored log's newest version, or an empty log if nothing has been stored yet.

    The schema is declared, so nothing is inferred and only the columns an operator uses are
    read; a filter on ``completed_date`` prunes folders. With ``first`` or ``last`` no folder
    of another day is even listed. ``extra`` names further columns the uploads had, as stored
    (``x_`` before their names); files without them give null. Rows stand in the order of
    ``batch``, then ``seq``.
    """
    return scan_log(spark, snapshot(spark, root).between(first, last), extra)


def scan_last_days(
    spark: SparkSession, root: str, days: int, extra: T.StructType | None = None
) -> DataFrame:
    """The stored log's latest day and the ``days`` before it. The latest day is known from
    the list of the log's folders, so the days returned are the only ones read."""
    return scan_log(spark, snapshot(spark, root).last_days(days), extra)


def scan_adjustments(spark: SparkSession, root: str) -> DataFrame:
    """The durations that the cleaning changed, of all batches of the newest version."""
    found = snapshot(spark, root)
    return adjustments_of(scan_log(spark, found)).selectExpr("batch", *ADJUSTMENTS)


def scan_export(
    spark: SparkSession,
    path: str,
    headers: Mapping[str, str] | None = None,
    vocabulary: Vocabulary = DEFAULT,
    dialect: CsvDialect = COMMA,
) -> DataFrame:
    """Uploaded CSV exports (a file, a folder or a pattern), numbered in upload order and typed."""
    return scan_uploads(spark, files_at(spark, path), headers, vocabulary, dialect)


def scan_legacy_log(
    spark: SparkSession, path: str, headers: Mapping[str, str] | None = None
) -> DataFrame:
    """A log stored as Parquet with times and durations in nanoseconds, typed.

    Spark reads nanosecond timestamps as whole numbers only while the session's
    ``spark.sql.legacy.parquet.nanosAsLong`` is set, also when the result is used; without
    it such a file is an error that says so.
    """
    try:
        raw = spark.read.parquet(path)
    except AnalysisException as problem:
        if "NANOS" not in str(problem):
            raise
        raise ValueError(
            "set spark.sql.legacy.parquet.nanosAsLong to true to read nanosecond timestamps"
        ) from problem
    if "seq" not in raw.columns and headers is not None:
        raw = raw.withColumn("seq", F.lit(None).cast("long"))
    return standardise_task_log(rename_headers(raw, headers or {}), "ns")


def scan_unavailability(
    spark: SparkSession, path: str, dialect: CsvDialect = COMMA
) -> DataFrame:
    """Lines ``start,end`` as timestamps; an unreadable side is null."""
    lines = spark.read.options(**dialect.options()).schema(UNAVAILABILITY_TEXT).csv(path)
    return lines.selectExpr(*[f"{parse_interval_time(c)} AS {c}" for c in lines.columns])
