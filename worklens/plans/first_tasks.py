"""The first task of each protocol, kept up to date batch by batch.

Each batch stores the first of its timed tasks per protocol and day. The first of a whole log,
or of a period, is the first of those, by batch and then place; a batch that is replaced
takes its own with it. Tasks without a protocol count as one protocol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from worklens.functions.sql import exprs
from worklens.sources.store import Snapshot, scan_beside

FIRSTS = T.StructType(
    [
        T.StructField("protocol_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("queue", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("day", T.DateType()),
    ]
)


def firsts_of_batches(log: DataFrame) -> DataFrame:
    """The first timed task of each protocol, batch and day of a stored log."""
    keyed = log.filter("duration_us IS NOT NULL").selectExpr(
        "protocol_id", "batch", "completed_date AS day", "seq", "queue", "outcome"
    )
    found = keyed.groupBy("protocol_id", "batch", "day").agg(
        *exprs({"first": "min_by(struct(seq, queue, outcome), seq)"})
    )
    return found.selectExpr("protocol_id", "first.*", "batch", "day")


def scan_first_tasks(spark: SparkSession, found: Snapshot) -> DataFrame:
    """The first timed tasks per protocol, batch and day of a snapshot; ``queue_summary`` takes
    them with the snapshot's cube in place of the log."""
    return scan_beside(spark, found, "firsts", FIRSTS, firsts_of_batches)
