"""Uploaded CSV files as people send them: each with its own header, in upload order."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.config import DEFAULT, Vocabulary
from worklens.operators.cleaning import (
    drop_listed_columns,
    rename_headers,
    standardise_task_log,
)
from worklens.schema import TASK_LOG
from worklens.sources.files import read_start
from worklens.sources.quoted import quoted_records
from worklens.sources.workbooks import SUFFIX, placed_workbooks


@dataclass(frozen=True)
class CsvDialect:
    """How a CSV file is written. Quotes within a cell are doubled, as spreadsheets do.

    With ``multi_line`` a quoted cell may hold line breaks. Files are read by many tasks all the
    same; by one task each only those that are zipped, in an encoding unlike ASCII, or with
    quotes, white space or carriage returns in odd places (see ``quoted``).
    """

    sep: str = ","
    encoding: str = "UTF-8"
    quote: str = '"'
    escape: str = '"'
    multi_line: bool = True

    def options(self) -> dict[str, str]:
        return {
            "sep": self.sep,
            "encoding": self.encoding,
            "quote": self.quote,
            "escape": self.escape,
            "multiLine": str(self.multi_line).lower(),
        }


COMMA = CsvDialect()


def files_at(spark: SparkSession, path: str) -> list[str]:
    """The files at a path; their contents are not read."""
    found = spark.read.format("binaryFile").load(path).select("path")
    return [r.path for r in found.collect()]  # one row per file


#: Bytes read of a file at first to find its header, and at most.
HEADER_BYTES, HEADER_LIMIT = 2**14, 2**24
#: Splits of a batch up to which their first numbers go to every task.
BROADCAST_SPLITS = 100_000


def first_record(spark: SparkSession, path: str, dialect: CsvDialect) -> str:
    """The header of a file, as it is written; line breaks in quotes are part of it. Only the
    start of the file is read."""
    size = HEADER_BYTES
    while True:
        raw = read_start(spark, path, size)
        # Spark reads zipped text by its name; its start can be unzipped alone.
        plain = zlib.decompressobj(31).decompress(raw) if raw and path.endswith(".gz") else raw
        text = plain.decode(dialect.encoding, "replace")
        parts = text.split("\n")
        record, quotes = [], 0
        for part in parts[:-1] if len(raw) == size else parts:
            record.append(part)
            quotes += part.count(dialect.quote)
            if quotes % 2 == 0 or not dialect.multi_line:
                return "\n".join(record).rstrip("\r")
        if len(raw) < size or size >= HEADER_LIMIT:
            return text.rstrip("\r\n")
        size = min(8 * size, HEADER_LIMIT)


def _by_header(spark: SparkSession, files: list[str], dialect: CsvDialect) -> list[list[str]]:
    """The files grouped by their header; empty ones are left out."""
    groups: dict[str, list[str]] = {}
    for path in files:
        header = first_record(spark, path, dialect)
        if header:
            groups.setdefault(header, []).append(path)
    return [sorted(group) for _, group in sorted(groups.items())]


#: Encodings whose line ends and quotes are the bytes that ASCII has for them.
ASCII_LIKE = frozenset({"utf-8", "utf8", "us-ascii", "iso-8859-1", "latin1", "windows-1252", "cp1252"})


#: Names by which Spark unzips text; such files are not split.
ZIPPED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")


def _by_line(spark: SparkSession, files: list[str], dialect: CsvDialect) -> CsvDialect:
    """The dialect that reads files without any quote line by line, split among tasks, if they
    read alike so: no line holds a carriage return or white space only. One pass that counts."""
    if not dialect.multi_line or dialect.encoding.lower() not in ASCII_LIKE:
        return dialect
    line = F.col("value")
    odd = F.contains(line, F.lit(dialect.quote)) | F.contains(line, F.lit("\r"))
    odd |= (line != "") & ~line.rlike(r"[^\x00-\x20]")
    found = spark.read.option("lineSep", "\n").text(files).where(odd)
    return replace(dialect, multi_line=False) if found.isEmpty() else dialect


def _placed(
    spark: SparkSession, files: list[str], dialect: CsvDialect, names: list[str]
) -> DataFrame:
    """The files' rows, and where they stand, read by Spark's reader alone."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    read = spark.read.options(header=True, **dialect.options())
    return read.schema(schema).option("enforceSchema", False).csv(files).selectExpr(
        "*",
        "_metadata.file_modification_time AS _up_time",
        "_metadata.file_path AS _up_path",
        "_metadata.file_block_start AS _up_block",
        "monotonically_increasing_id() AS _up_place",
    )


def _placed_by_record(
    spark: SparkSession, files: list[str], dialect: CsvDialect, names: list[str]
) -> DataFrame:
    """The same of files with quotes: their lines are made records, which Spark parses. Files
    that can't be taken apart so are read by one task each."""
    ways = (dialect.sep, dialect.quote, dialect.encoding)
    records, odd = quoted_records(spark, files, *ways)
    parts = []
    if records is not None:
        cells = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
        parsed = F.from_csv("text", cells, {**dialect.options(), "lineSep": "\n"})
        parts.append(
            records.withColumn("row", parsed).selectExpr(
                "row.*", "timestamp_micros(time) AS _up_time", "path AS _up_path",
                "block AS _up_block", "place AS _up_place",
            )
        )
    if odd:
        parts.append(_placed(spark, files, dialect, names).where(F.col("_up_path").isin(odd)))
    return reduce(DataFrame.unionByName, parts) if parts else _placed(spark, files, dialect, names)


def _followable(files: list[str], dialect: CsvDialect) -> bool:
    return (
        dialect.multi_line
        and dialect.encoding.lower() in ASCII_LIKE
        and dialect.quote == dialect.escape
        and all(len(c) == 1 and c.isascii() and c not in "\r\n" for c in (dialect.sep, dialect.quote))
        and not any(f.lower().endswith(ZIPPED) for f in files)
    )


def number_rows(placed: DataFrame) -> DataFrame:
    """Numbers rows from zero in upload order: by the file's time and name, then as they
    stand in it.

    Needs the columns that ``scan_uploads`` adds to each scan. Counts per split of a file
    give every split its first number, so the order depends neither on the splits' sizes
    nor on which task reads them. The numbers of the splits, one row each, go to every task, so
    that no row moves; beyond ``BROADCAST_SPLITS`` Spark chooses the join.
    """
    splits = placed.groupBy("_up_time", "_up_path", "_up_block").agg(
        {"_up_place": "min", "*": "count"}
    )
    counted = splits.collect()  # one row a split
    begins, upto = [], 0
    for r in sorted(counted, key=lambda r: (r._up_time, r._up_path, r._up_block)):
        begins.append((r._up_path, r._up_block, upto - r["min(_up_place)"]))
        upto += r["count(1)"]
    table = placed.sparkSession.createDataFrame(
        begins, "b_path STRING, b_block BIGINT, b_shift BIGINT"
    )
    if len(begins) <= BROADCAST_SPLITS:
        table = F.broadcast(table)
    on = (placed["_up_path"] == table["b_path"]) & (placed["_up_block"] == table["b_block"])
    numbered = placed.join(table, on).withColumn("seq", placed["_up_place"] + table["b_shift"])
    return numbered.drop(
        "_up_time", "_up_path", "_up_block", "_up_place", "b_path", "b_block", "b_shift"
    )


def scan_uploads(
    spark: SparkSession,
    files: Iterable[str],
    headers: Mapping[str, str] | None = None,
    vocabulary: Vocabulary = DEFAULT,
    dialect: CsvDialect = COMMA,
    sheet: str | None = None,
) -> DataFrame:
    """The rows of the files, CSV or workbooks, as one typed log, numbered in upload order.

    Files may have their columns in any order, lack some, or have new ones: those with
    one header are read together, and columns are matched by name. Without files, or
    with empty ones only, the log has no rows.
    """
    files = list(files)
    books = [f for f in files if f.lower().endswith(SUFFIX)]
    parts = []
    placed = placed_workbooks(spark, books, sheet) if books else None
    if placed is not None:
        parts.append(rename_headers(drop_listed_columns(placed, vocabulary), headers or {}))
    for group in _by_header(spark, [f for f in files if f not in set(books)], dialect):
        own = _by_line(spark, group, dialect)
        names = spark.read.options(header=True, **own.options()).csv(group[0]).columns
        way = _placed_by_record if _followable(group, own) else _placed
        placed = drop_listed_columns(way(spark, group, own, names), vocabulary)
        parts.append(rename_headers(placed, headers or {}))
    if not parts:
        empty = T.StructType([f for f in TASK_LOG if f.name != "seq"])
        return standardise_task_log(spark.createDataFrame([], empty))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return standardise_task_log(number_rows(whole))
