"""CSV files whose quoted cells hold line breaks, read by many tasks.

A line may begin within a cell, so what it means depends on the lines before it. A first pass
follows every split of a file from both states, a record's start and the inside of a cell, and
tells where each leads: one row a split. Put together, these give each split the state in which
it begins. A second pass makes records of lines; those that reach into later splits are put
together by a shuffle of their pieces alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, INSIDE, ODD = 0, 1, 2
#: What a line of white space may hold; such lines are not records to all of Spark's readers.
BLANK = bytes(range(33))

SPLIT = (
    "path string, block long, length long, end0 int, ends0 long, returns0 long,"
    " end1 int, ends1 long, returns1 long"
)
RECORD = "time long, path string, block long, place long, piece long, text string"


class Grammar:
    """What a line does. Only cells that are quoted whole, or not at all, are followed: all else,
    and carriage returns that don't end lines, are ``ODD``."""

    def __init__(self, sep: str, quote: str) -> None:
        s, q = re.escape(sep.encode()), re.escape(quote.encode())
        inside = b"[^%b]*+(?:%b%b[^%b]*+)*+" % (q, q, q, q)
        cell = b"(?:%b%b%b|(?:[^%b%b\r][^%b\r]*+)?+)" % (q, inside, q, q, s, s)
        self.sep, self.quote = sep.encode(), quote.encode()
        self.closes = re.compile(inside + q).match
        self.whole = re.compile(b"%b(?:%b%b)*+" % (cell, s, cell)).fullmatch
        self.opens = re.compile(b"(?:%b%b)*+%b%b" % (cell, s, q, inside)).fullmatch

    def after(self, line: bytes, state: int) -> int:
        """The state after a line without its line break."""
        if state == ODD:
            return ODD
        if state == INSIDE:
            if self.quote not in line:
                return INSIDE
            closed = self.closes(line)
            if not closed:
                return INSIDE
            line = line[closed.end() :]
            if not line or line == b"\r":
                return START
            if not line.startswith(self.sep):
                return ODD
            line = line[len(self.sep) :]
        elif line not in (b"", b"\r") and not line.strip(BLANK):
            return ODD
        if self.whole(line[:-1] if line.endswith(b"\r") else line):
            return START
        return INSIDE if self.opens(line) else ODD


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The lines with the split that each is of, and whether it is the split's first."""
    last = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            *split, line = row
            yield tuple(split), split != last, line
            last = split


def _followed(sep: str, quote: str):
    """One row a split: from either state, the state it ends in, how many records end within it
    and how many of these by a carriage return too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(sep, quote)
        rows, states, ends, returns = [], [], [], []

        def close() -> None:
            rows[-1] += tuple(v for h in (0, 1) for v in (states[h], ends[h], returns[h]))

        for split, first, line in _splits(batches):
            if first:
                if rows:
                    close()
                rows.append(split[:3])
                states, ends, returns = [START, INSIDE], [0, 0], [0, 0]
                # The first line break of a file tells which kind it has.
                if split[1] == 0 and b"\r" in line[:-1]:
                    states[0] = ODD
            ended = line.endswith(b"\r")
            then = {s: grammar.after(line, s) for s in set(states)}
            for h, state in enumerate(states):
                states[h] = then[state]
                if states[h] == START:
                    ends[h] += 1
                    returns[h] += ended
        if rows:
            close()
            columns = [pa.array(c) for c in zip(*rows)]
            kinds = [pa.string(), *[pa.int64()] * 2, *[pa.int32(), pa.int64(), pa.int64()] * 2]
            names = [part.split()[0] for part in SPLIT.split(", ")]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names)

    return run


@dataclass(frozen=True)
class Begin:
    """How a split begins: in which state, and in which split the record open there began."""

    state: int
    owner: int
    returns: bool


def begins(splits: list) -> tuple[dict[tuple, Begin], list[str]]:
    """How each split begins, and the files that can't be followed."""
    found, odd = {}, []
    files: dict[str, list] = {}
    for r in splits:
        files.setdefault(r.path, []).append(r)
    for path, own in files.items():
        state, owner, ends, returns, ways = START, 0, 0, 0, {}
        for r in sorted(own, key=lambda r: r.block):
            ways[r.path, r.block, r.length] = (state, owner)
            there = (r.end0, r.ends0, r.returns0) if state == START else (r.end1, r.ends1, r.returns1)
            if state == START or there[1]:
                owner = r.block
            state, ends, returns = there[0], ends + there[1], returns + there[2]
            if state == ODD:
                break
        if state != START or 0 < returns < ends:
            odd.append(path)
        else:
            found |= {k: Begin(*way, returns > 0) for k, way in ways.items()}
    return found, odd


def _records(sep: str, quote: str, encoding: str, known: dict[tuple, Begin], open_only: bool):
    """The records of each split, numbered as they begin in it. What is of a record that
    crosses splits comes as a piece, only that if ``open_only``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(sep, quote)
        rows, held, state, place, size = [], [], START, 0, 0
        begin = split = None

        def batch() -> pa.RecordBatch:
            fields = [f.split() for f in RECORD.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)],
                [name for name, _ in fields],
            )

        def put(piece: bool) -> None:
            """``begin.state`` is INSIDE until the record that was open is over."""
            nonlocal size
            path, block, _, time = split
            # Pieces are joined by the line breaks between them.
            text = b"\n".join(held)
            size += len(text)
            head = state_at == INSIDE
            if not open_only or head or piece:
                rows.append(
                    (
                        time, path, begin.owner if head else block, -1 if head else place,
                        block if head or piece else None, text.decode(encoding, "replace"),
                    )
                )

        for at, first, line in _splits(batches):
            if first:
                if held:
                    put(True)
                split, held, place = at, [], 0
                begin = known[at[:3]]
                state = state_at = begin.state
            if state == START and line in (b"", b"\r"):
                continue
            state = grammar.after(line, state)
            # Spark's reader, too, takes every line break of such a file as a line feed.
            held.append(line.removesuffix(b"\r") if begin.returns else line)
            if state == START:
                put(False)
                place += state_at != INSIDE
                held, state_at = [], START
                if len(rows) >= 8192 or size > 1 << 24:
                    if rows:
                        yield batch()
                    rows, size = [], 0
        if held:
            put(True)
        if rows:
            yield batch()

    return run


def lines_of(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(files).selectExpr(
        "_metadata.file_path AS path", "_metadata.file_block_start AS block",
        "_metadata.file_block_length AS length",
        "unix_micros(_metadata.file_modification_time) AS time", "CAST(value AS BINARY) AS line",
    )


def quoted_records(
    spark: SparkSession, files: list[str], sep: str, quote: str, encoding: str
) -> tuple[DataFrame | None, list[str]]:
    """The files' records without their headers, as written, one row each: ``time``, ``path``,
    ``block`` (where the split begins that it begins in), ``place`` (its number there) and
    ``text``; and the files that can't be followed, whose records are not among them."""
    lines = lines_of(spark, files)
    splits = lines.mapInArrow(_followed(sep, quote), SPLIT).collect()  # one row a split
    known, odd = begins(splits)
    if not known:
        return None, odd
    if odd:
        lines = lines.where(~F.col("path").isin(odd))

    def made(open_only: bool) -> DataFrame:
        run = _records(sep, quote, encoding, known, open_only)
        return lines.mapInArrow(run, RECORD)

    found = made(False)
    if any(b.state == INSIDE for b in known.values()):
        pieces = made(True).where("piece IS NOT NULL")
        joined = pieces.groupBy("time", "path", "block").agg(
            F.max("place").alias("place"),
            F.lit(None).cast("long").alias("piece"),
            F.expr(
                "array_join(transform(sort_array(collect_list(struct(piece, text))), x -> x.text), '\\n')"
            ).alias("text"),
        )
        found = found.where("piece IS NULL").unionByName(joined)
    return found.where("NOT (block = 0 AND place = 0)").drop("piece"), odd
