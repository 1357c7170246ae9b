"""Session helpers: local sessions for tests and benches, shared scratch space."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = "*", app: str = "worklens", memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A single-machine session; on a cluster the caller brings their own.

    ``shared`` is the folder for checkpoints and scratch tables.
    """
    shuffles = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    builder = SparkSession.builder
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", shuffles)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, private to this application.

    It lies in the folder that the session's ``spark.checkpoint.dir`` names, else in
    the session's warehouse; never in a machine's temporary folder, whose files the
    other machines would not see.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/worklens-{context.applicationId}"
