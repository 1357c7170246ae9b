"""Rows of an upload that the stored log already holds.

Each day of a segment has a filter of its rows: words of 64 bits, four of which every row
sets in one word, some 16 bits a row. The rows of an upload are looked up in the filters of
their days; only where one of them may be stored is that day's text read, for an exact
anti-join on all declared columns. An upload with nothing repeated reads no stored text.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.calendar import day_of
from worklens.schema import DURATION_BEFORE, TASK_LOG
from worklens.sources import store

#: Rows that share a word, on average at most.
ROWS_PER_WORD = 4

WORDS = "day DATE, word BIGINT, bits BIGINT, segment STRING"

#: What makes two rows the same: all declared columns but the number of the row.
IDENTITY = [f.name for f in TASK_LOG if f.name != "seq"]


def _shown(rows: DataFrame, duration: str) -> str:
    """The columns of the identity, those that the rows lack as nulls."""
    have = set(rows.columns)
    shown = []
    for f in TASK_LOG:
        source = duration if f.name == "duration_us" else f.name
        sql = f"`{source}`" if source in have else f"CAST(NULL AS {f.dataType.simpleString()})"
        if f.name == "justification":
            sql = f"coalesce({sql}, '')"
        if f.name in IDENTITY:
            shown.append(f"{sql} AS {f.name}")
    return ", ".join(shown)


def _fields(row: str) -> str:
    return ", ".join(f"{row}.{name}" for name in IDENTITY)


def _identity(rows: DataFrame, duration: str) -> DataFrame:
    """The declared columns as they were uploaded, their hash, and the day."""
    day = "completed_date" if "completed_date" in rows.columns else day_of(rows)
    columns = rows.selectExpr(f"struct({_shown(rows, duration)}) AS row", f"{day} AS day")
    return columns.selectExpr("row.*", "day", f"xxhash64({_fields('row')}) AS print")


def _bits() -> str:
    """Four bits of a word, from the lower bits of the hash."""
    picked = [f"shiftleft(1L, CAST(shiftright(print, {at}) & 63 AS INT))" for at in (0, 6, 12, 18)]
    return f"({' | '.join(picked)})"


WORD = "pmod(shiftright(print, 24), words)"


def stage_words(
    rows: DataFrame, root: str, segment: str, entries: list[store.Entry]
) -> list[store.Entry]:
    """Writes the filters of a segment's days; returns its entries with their sizes."""
    sized = [replace(e, words=max(1, -(-e.rows // ROWS_PER_WORD))) for e in entries]
    sizes = rows.sparkSession.createDataFrame(
        [(e.day, e.words) for e in sized], "of_day STRING, words BIGINT"
    )
    known = _identity(rows, DURATION_BEFORE.name)
    # one row a day of the segment
    counted = known.join(sizes, F.expr("CAST(day AS STRING) <=> of_day"))
    words = counted.selectExpr("day", f"{WORD} AS word", f"{_bits()} AS bits")
    words.groupBy("day", "word").agg(F.expr("bit_or(bits) AS bits")).write.parquet(
        f"{root}/words/segment={segment}"
    )
    return sized


def may_hold(rows: DataFrame, found: store.Snapshot) -> store.Snapshot:
    """The entries of the stored log that may hold some of the rows: those whose filter says
    so, and those of the rows' days that have no filter. Reads filters only."""
    spark = rows.sparkSession
    probes = _identity(rows, "duration_us").select("day", "print").distinct()
    listed = spark.createDataFrame(
        [(e.segment, e.day, e.words) for e in found.entries],
        "segment STRING, of_day STRING, words BIGINT",
    )
    asked = probes.join(listed, F.expr("CAST(day AS STRING) <=> of_day"))
    segments = sorted({e.segment for e in found.entries if e.words})
    hits = asked.where("words = 0").select("segment", "of_day")
    if segments:
        words = (
            spark.read.schema(WORDS)
            .option("basePath", f"{found.root}/words")
            .parquet(*[f"{found.root}/words/segment={s}" for s in segments])
            .selectExpr("segment AS w_segment", "day AS w_day", "word", "bits")
        )
        on = f"words > 0 AND segment = w_segment AND day <=> w_day AND {WORD} = word"
        hits = hits.union(
            asked.join(words, F.expr(on))
            .where(f"bits & {_bits()} = {_bits()}")
            .select("segment", "of_day")
        )
    # one row an entry at most
    held = {(r.segment, r.of_day) for r in hits.distinct().collect()}
    return replace(found, entries=tuple(e for e in found.entries if (e.segment, e.day) in held))


def new_rows(rows: DataFrame, found: store.Snapshot) -> DataFrame:
    """The rows of an upload that no stored batch holds. Rows are the same if all declared
    columns are, as uploaded, whatever their number in the file; nulls equal nulls. Rows that
    an upload holds several times stay so."""
    held = may_hold(rows, found) if found.entries else found
    if not held.entries:
        return rows
    stored = _identity(store.scan_log(rows.sparkSession, held), DURATION_BEFORE.name)
    stored = stored.drop("day").distinct().selectExpr(
        "print AS _stored_print", f"struct({', '.join(IDENTITY)}) AS _stored"
    )
    own = rows.selectExpr("*", f"struct({_shown(rows, 'duration_us')}) AS _own")
    own = own.withColumn("_own_print", F.expr(f"xxhash64({_fields('_own')})"))
    left = own.join(stored, F.expr("_own_print = _stored_print AND _own <=> _stored"), "left_anti")
    return left.drop("_own", "_own_print")
