"""One scan of the log for many operators.

A page of the overview shows some twenty tables; run each over the log and the
log is read twenty times. The cube holds the additive measures per day,
analyst, queue, outcome, status and doubt flag, and the operators accept it in
place of the log. Its grouping combines before the shuffle, so an analyst or
queue that holds a third of all tasks sends at most one row per map task and key.

Measures only add up, so a cube need not be recomputed either: each batch adds
its own cube beside the earlier ones, and operators sum over all of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.functions.calendar import day_of, is_cube
from worklens.functions.measures import MEASURES, with_measures
from worklens.functions.sql import exprs
from worklens.sources.store import Snapshot, scan_beside

KEYS = ("day", "analyst", "queue", "outcome", "status", "over_doubt_limit")

CUBE = T.StructType(
    [
        T.StructField("analyst", T.StringType()),
        T.StructField("queue", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("over_doubt_limit", T.BooleanType()),
        *[T.StructField(m, T.LongType()) for m in MEASURES],
        T.StructField("batch", T.IntegerType()),
        T.StructField("day", T.DateType()),
    ]
)


def activity_cube(log: DataFrame) -> DataFrame:
    keyed = with_measures(log)
    if not is_cube(keyed):
        keyed = keyed.withColumn("day", F.expr(day_of(log)))
    return keyed.groupBy(*KEYS).agg(*exprs({m: f"sum({m})" for m in MEASURES}))


def add_to_cube(batch: DataFrame, batch_no: int, path: str) -> None:
    """Store the cube of one clean batch in its own folder, which a repeated write replaces
    whole, whatever days it held before."""
    (
        activity_cube(batch)
        .hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("day")
        .parquet(f"{path}/batch={int(batch_no)}")
    )


def cube_of_batches(log: DataFrame) -> DataFrame:
    """The cube of a stored log, each batch by itself."""
    keyed = with_measures(log).withColumn("day", F.expr(day_of(log)))
    cube = keyed.groupBy(*KEYS, "batch").agg(*exprs({m: f"sum({m})" for m in MEASURES}))
    return cube.select(*CUBE.names)


def scan_stored_cube(spark: SparkSession, found: Snapshot) -> DataFrame:
    """The cube of a snapshot of the stored log."""
    return scan_beside(spark, found, "cube", CUBE, cube_of_batches)


def scan_cube(spark: SparkSession, path: str) -> DataFrame:
    """The stored cubes of all batches, or an empty one; ``day`` prunes files."""
    try:
        return spark.read.schema(CUBE).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CUBE)
