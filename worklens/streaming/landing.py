"""Uploads landing in a folder, each cleaned once and added to the stored log.

The stream's checkpoint remembers which files were taken, so an upload is never
added twice; a batch repeated after a failure replaces its own earlier output.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from worklens.config import DEFAULT, Vocabulary
from worklens.sources.uploads import COMMA, CsvDialect, scan_uploads
from worklens.sources.writers import write_task_log


def ingest_landed(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    headers: Mapping[str, str] | None = None,
    first_batch: int = 0,
    files_per_batch: int = 1000,
    vocabulary: Vocabulary = DEFAULT,
    dialect: CsvDialect = COMMA,
    with_cube: bool = False,
    new_rows_only: bool = False,
    with_idle: bool = False,
    with_firsts: bool = False,
) -> None:
    """Take every CSV export now in ``landing`` that has not been taken before.

    Files come in the order of their times, and each file's columns are matched by name,
    so the order of the stored rows is the same for any ``files_per_batch``. Batches are
    numbered from ``first_batch``, which must lie above the numbers written in other ways.
    The other switches are those of ``write_task_log``; ``new_rows_only`` leaves out
    what an export that comes twice under another name holds again.
    """
    uploads = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .select("path")  # the files' contents are not read here
    )

    def add(batch: DataFrame, epoch: int) -> None:
        files = [r.path for r in batch.collect()]  # at most files_per_batch names
        typed = scan_uploads(spark, files, headers, vocabulary, dialect)
        write_task_log(
            typed, first_batch + epoch, root, vocabulary, with_cube, new_rows_only, with_idle,
            with_firsts,
        )

    query = (
        uploads.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
