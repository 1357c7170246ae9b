"""Small files beside the tables, in whatever file system the session's paths name.

Tables are read and written by Spark. What Spark has no call for, a pointer that is switched
by one rename and the removal of folders, goes through the same Hadoop file system.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    system, path = _at(spark, folder)
    if not system.exists(path):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(path))


def read_text(spark: SparkSession, path: str) -> str:
    system, at = _at(spark, path)
    stream = system.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_start(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, ``size`` at most."""
    system, at = _at(spark, path)
    stream = system.open(at)
    try:
        # The whole array comes back, filled as far as the file goes.
        length = min(size, system.getFileStatus(at).getLen())
        found = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(length))
        return bytes(found)
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file whole or not at all: under another name first, then renamed. A file that
    is already there is an error."""
    system, to = _at(spark, path)
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    _, at = _at(spark, hidden)
    stream = system.create(at, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if system.exists(to) or not system.rename(at, to):
        system.delete(at, False)
        raise FileExistsError(path)


def order_times(spark: SparkSession, folder: str) -> None:
    """Gives the files that a job wrote into a folder times in the order of their names, a
    millisecond apart, up to the time of the last."""
    system, path = _at(spark, folder)
    found = [s for s in system.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]
    found.sort(key=lambda s: s.getPath().getName())
    last = max((s.getModificationTime() for s in found), default=0)
    for before, status in enumerate(reversed(found)):
        system.setTimes(status.getPath(), last - before, -1)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)
