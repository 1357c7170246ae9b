"""Writers: the stored task log with its adjustment log, and exports."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.config import DEFAULT, Vocabulary
from worklens.functions.calendar import day_of
from worklens.operators.cleaning import (
    ADJUSTMENTS,
    adjustments_of,
    clamp_durations,
    drop_listed_columns,
    exclude_robot_and_unassigned,
    export_columns,
    extra_columns,
)
from worklens.plans.cube import CUBE, cube_of_batches
from worklens.plans.first_tasks import FIRSTS, firsts_of_batches
from worklens.plans.idle_cube import IDLE, idle_of_batches
from worklens.schema import DURATION_BEFORE, TASK_LOG
from worklens.sources import repeats, store
from worklens.sources.uploads import COMMA, CsvDialect

#: The tables that a segment may have beside the log: what they hold, and how it is made.
BESIDE = {
    "cube": (CUBE, cube_of_batches),
    "idle": (IDLE, idle_of_batches),
    "firsts": (FIRSTS, firsts_of_batches),
}

NO_ADJUSTMENT = "No duration adjustment was needed."


def write_task_log(
    batch: DataFrame,
    batch_no: int,
    root: str,
    vocabulary: Vocabulary = DEFAULT,
    with_cube: bool = False,
    new_rows_only: bool = False,
    with_idle: bool = False,
    with_firsts: bool = False,
) -> bool:
    """Clean one batch, add it to the stored log, log its adjustments; tells if there were any.

    Only the batch is written, never the stored log: its rows, its adjustments (as CSV, or
    one line that there were none) and, ``with_cube``, ``with_idle`` and ``with_firsts``, its
    cube, its summaries of idle time and its protocols' first tasks are staged, and then all are switched to at once. A batch of the
    same number is replaced whole in the same step. Until then, and after a write that died,
    readers see the version before.
    With ``new_rows_only`` rows that the store already holds in other batches are left out
    (see ``repeats``). Columns beyond the declared ones are stored with ``x_`` before their
    names.
    """
    spark = batch.sparkSession
    found = store.snapshot(spark, root)
    kept = exclude_robot_and_unassigned(drop_listed_columns(batch, vocabulary), vocabulary)
    # absent only when the batch was not standardised
    if "justification" not in kept.columns:
        kept = kept.withColumn("justification", F.lit(""))
    if new_rows_only:
        kept = repeats.new_rows(kept, store.without_batch(found, batch_no))
    if "duration_us" in kept.columns:
        kept = kept.withColumn(DURATION_BEFORE.name, F.col("duration_us"))
    clean = clamp_durations(kept, vocabulary)
    own = {f.name: f.dataType.simpleString() for f in (*TASK_LOG, DURATION_BEFORE)}
    derived = ("completed_date", "completed_month", "batch")
    rows = clean.selectExpr(
        *[f"CAST(`{c}` AS {own[c]}) AS `{c}`" for c in clean.columns if c in own],
        *extra_columns([c for c in clean.columns if c not in (*own, *derived)]),
        f"{int(batch_no)} AS batch",
        f"{day_of(clean)} AS completed_date",
    )
    segment = store.new_segment()
    entries = store.stage_log(rows, root, segment)
    new = replace(
        store.without_batch(found, batch_no),
        extra=found.extra | {segment: store.extra_types(rows.schema)},
    )
    written = store.scan_log(spark, replace(new, entries=tuple(entries)))
    asked = {"cube": with_cube, "idle": with_idle, "firsts": with_firsts}
    beside = tuple(table for table, wanted in asked.items() if wanted and entries)
    for table in beside:
        store.stage_beside(BESIDE[table][1](written), table, root, segment)
    entries = store.with_beside(spark, root, entries, beside)
    if new_rows_only and entries:
        entries = repeats.stage_words(written, root, segment, entries)
    adjusted = any(e.adjusted for e in entries)
    target = f"{root}/adjustments/segment={segment}"
    if adjusted:
        adjustments_in(written).write.csv(target, header=True)
    else:
        message = spark.createDataFrame([(NO_ADJUSTMENT,)], "message string")
        message.coalesce(1).write.text(target)
    store.switch(
        spark,
        replace(
            new,
            entries=(*new.entries, *entries),
            adjustments=found.adjustments | {int(batch_no): segment},
        ),
    )
    return adjusted


def compact_log(spark: SparkSession, root: str) -> None:
    """Merges the days of the stored log that several batches hold, with their cubes,
    idle times and filters, so that a period reads one folder a day. The rows stay as they are."""

    def words(segment: str, entries: list[store.Entry]) -> list[store.Entry]:
        merged = store.Snapshot(root, entries=tuple(entries))
        return repeats.stage_words(store.scan_log(spark, merged), root, segment, entries)

    store.compact(spark, root, {table: schema for table, (schema, _) in BESIDE.items()}, words)


def adjustments_in(stored: DataFrame) -> DataFrame:
    """The durations that the cleaning of a stored batch changed, before and after."""
    return adjustments_of(stored).selectExpr(*ADJUSTMENTS)


def write_columns(
    df: DataFrame, columns: Iterable[str], path: str, dialect: CsvDialect = COMMA
) -> None:
    """The chosen columns as CSV with a header, quotes doubled as spreadsheets read them."""
    options = {k: v for k, v in dialect.options().items() if k != "multiLine"}
    export_columns(df, columns).write.mode("overwrite").options(header=True, **options).csv(path)
