"""Help shared by the corpus operators: reading, keeping, and splitting text into words."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from worklens.session import shared_dir

#: White space of the word rules, as bytes: space, tab, line feed, vertical tab, form feed, return.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_dir(spark: SparkSession, what: str) -> str:
    """A folder of its own that every executor can reach."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows as a written table in the shared folder, read back: its lineage ends there,
    so that neither a lost executor nor a second use computes them again."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the files of shuffles that
    nothing needs any more; else they stay on disk until it happens to do so. Spark's listeners
    hold the last query, so it must not be the one with the shuffles."""
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns a worker's free memory to the machine: workers outlive their tasks, and what
    one stage's worker keeps for itself the next stage's JVM lacks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable, rows: int = 1024) -> Iterator:
    """The record batches in short pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def own_to_worker(key: tuple, make: Callable):
    """What a Python worker keeps from one of its tasks to the next, made when first needed.
    One thing per kind is kept (the kind is the first part of ``key``)."""
    store = sys.modules.setdefault("_worklens_worker", types.ModuleType("_worklens_worker"))
    held = getattr(store, key[0], None)
    if held is None or held[0] != key:
        held = (key, make())
        setattr(store, key[0], held)
    return held[1]


def id_crc(id_column: str = "doc_id") -> str:
    """SQL: crc32 of an id as text; a null id counts as empty text."""
    return f"crc32(coalesce(cast({id_column} AS STRING), ''))"
