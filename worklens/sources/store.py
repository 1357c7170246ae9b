"""The stored log: versions of one list of segments, switched by one rename.

A segment is what one write adds: folders ``log/segment=S/completed_date=D`` and, if asked
for, tables beside the log (``cube/segment=S/day=D``) and ``adjustments/segment=S``. Nobody reads a segment that the
newest version does not list, so a write stages whatever it needs and then switches; killed
before that it leaves the old version as it was, log, cube and adjustments together.

Batches are deltas. ``compact`` merges the days that several segments hold into a base, day
by day, so that a period lists one folder a day however many batches were written. A batch
that is replaced after that stays in the base files and is hidden there until the next
compaction of the day.

The list has one entry a day and segment, with zones (rows, first and last start), so that
scans are cut to their days before any folder is listed. It is small, one entry a day once
compacted, and the driver holds it. One writer at a time; a second one fails to switch.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.functions.sql import exprs
from worklens.schema import DURATION_BEFORE, TASK_LOG
from worklens.sources.files import names_in, read_text, remove, write_new

VERSIONS = "_versions"
#: How a folder of rows without a day is named, and the first and last of days.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"

STORED_LOG = T.StructType(
    TASK_LOG.fields
    + [
        DURATION_BEFORE,
        T.StructField("batch", T.IntegerType()),
        T.StructField("completed_date", T.DateType()),
    ]
)


@dataclass(frozen=True)
class Entry:
    """One folder of the log: a day of a segment."""

    segment: str
    day: str | None
    batches: tuple[int, ...]
    rows: int
    first_start: str | None = None
    last_start: str | None = None
    #: Rows whose duration the cleaning changed.
    adjusted: int = 0
    hidden: tuple[int, ...] = ()
    #: The tables that the segment has beside the log.
    beside: tuple[str, ...] = ()
    #: Those of them that have no rows on this day, and so no folder.
    bare: tuple[str, ...] = ()
    #: Words of the filter of its rows; none if it has no filter.
    words: int = 0

    def without(self, batch: int) -> Entry | None:
        """The entry when a batch is gone; none if nothing is left."""
        if batch not in self.batches:
            return self
        hidden = tuple(sorted({*self.hidden, batch}))
        return None if set(hidden) >= set(self.batches) else replace(self, hidden=hidden)


@dataclass(frozen=True)
class Snapshot:
    """What one version lists. Reading it later still gives that version's rows, as long as
    ``expire`` has not removed them."""

    root: str
    version: int = 0
    entries: tuple[Entry, ...] = ()
    #: Batch to the segment of its adjustments.
    adjustments: dict[int, str] = field(default_factory=dict)
    #: Columns of segments beyond the declared ones: name to type.
    extra: dict[str, dict[str, str]] = field(default_factory=dict)

    def days(self) -> list[dt.date]:
        return sorted({dt.date.fromisoformat(e.day) for e in self.entries if e.day})

    def between(self, first: dt.date | None, last: dt.date | None) -> Snapshot:
        """The entries of a period; without limits all, those without a day among them."""
        if first is None and last is None:
            return self
        low = first.isoformat() if first else ""
        high = last.isoformat() if last else "9999-99-99"
        return replace(
            self, entries=tuple(e for e in self.entries if e.day and low <= e.day <= high)
        )

    def last_days(self, days: int) -> Snapshot:
        """The latest day and ``days`` before it, known without reading any row."""
        found = self.days()
        return self.between(found[-1] - dt.timedelta(days), None) if found else self


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest version of the store, or a given one; nothing stored yet is version 0."""
    if version is None:
        found = [n for n in names_in(spark, f"{root}/{VERSIONS}") if n[0].isdigit()]
        if not found:
            return Snapshot(root)
        version = int(found[-1].split(".")[0])
    listed = json.loads(read_text(spark, _version_path(root, version)))
    entries = [
        Entry(**{**e, **{f: tuple(e[f]) for f in ("batches", "hidden", "beside", "bare")}})
        for e in listed["entries"]
    ]
    adjustments = {int(b): s for b, s in listed["adjustments"].items()}
    return Snapshot(root, version, tuple(entries), adjustments, listed["extra"])


def _version_path(root: str, version: int) -> str:
    return f"{root}/{VERSIONS}/{version:010d}.json"


def switch(spark: SparkSession, to: Snapshot) -> Snapshot:
    """Makes a list the newest version: the one step that readers see."""
    new = replace(to, version=to.version + 1)
    listed = {"entries": [asdict(e) for e in new.entries]}
    listed |= {"adjustments": new.adjustments, "extra": new.extra}
    write_new(spark, _version_path(new.root, new.version), json.dumps(listed))
    return new


def _folder(root: str, table: str, key: str, entry: Entry) -> str:
    return f"{root}/{table}/segment={entry.segment}/{key}={entry.day or NO_DAY}"


def scan_segments(
    spark: SparkSession, found: Snapshot, table: str, key: str, schema: T.StructType
) -> DataFrame:
    """The rows of a snapshot's folders, without batches that are hidden there."""
    found = replace(found, entries=tuple(e for e in found.entries if table not in e.bare))
    if not found.entries:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("segment", T.StringType())])
    rows = (
        spark.read.schema(whole)
        .option("basePath", f"{found.root}/{table}")
        .parquet(*[_folder(found.root, table, key, e) for e in found.entries])
    )
    # One condition for all days on which a segment hides the same batches.
    hidden: dict[tuple, list[Entry]] = {}
    for e in found.entries:
        if e.hidden:
            hidden.setdefault((e.segment, e.hidden), []).append(e)
    for (segment, batches), entries in hidden.items():
        listed = ", ".join(map(str, batches))
        days = ", ".join(f"'{e.day}'" if e.day else f"'{NO_DAY}'" for e in entries)
        rows = rows.where(
            f"NOT (segment = '{segment}' AND batch IN ({listed})"
            f" AND coalesce(CAST({key} AS STRING), '{NO_DAY}') IN ({days}))"
        )
    return rows.select(*[f"`{c}`" for c in schema.names])


def scan_log(
    spark: SparkSession, found: Snapshot, extra: T.StructType | None = None
) -> DataFrame:
    """The log of a snapshot; ``extra`` names further columns, as stored."""
    schema = T.StructType([*(extra.fields if extra else []), *STORED_LOG.fields])
    log = scan_segments(spark, found, "log", "completed_date", schema)
    return log.withColumn("justification", F.coalesce("justification", F.lit("")))


def new_segment() -> str:
    return uuid.uuid4().hex


def stage_log(rows: DataFrame, root: str, segment: str) -> list[Entry]:
    """Writes a segment of the log, a folder a day, and returns its entries."""
    path = f"{root}/log/segment={segment}"
    (
        # a day of any size is split into files of the advisory size
        rows.hint("rebalance", "completed_date")
        .sortWithinPartitions(*[c for c in ("completed_date", "batch", "seq") if c in rows.columns])
        .write.partitionBy("completed_date")
        .parquet(path)
    )
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    changed = "count_if(duration_before_us <> duration_us)"
    zones = written.groupBy("completed_date").agg(
        *exprs(
            {
                # the batches of one day
                "batches": "array_sort(collect_set(batch))",
                "rows": "count(*)",
                "first_start": f"CAST(min({_or_null(written, 'started_at')}) AS STRING)",
                "last_start": f"CAST(max({_or_null(written, 'started_at')}) AS STRING)",
                "adjusted": changed if DURATION_BEFORE.name in rows.columns else "0L",
            }
        )
    )
    return [
        Entry(
            segment, r.completed_date and r.completed_date.isoformat(), tuple(r.batches), r.rows,
            r.first_start, r.last_start, r.adjusted,
        )
        for r in zones.collect()  # one row a day
    ]


def _or_null(df: DataFrame, column: str) -> str:
    return column if column in df.columns else "CAST(NULL AS TIMESTAMP_NTZ)"


def stage_beside(rows: DataFrame, table: str, root: str, segment: str) -> None:
    """Writes a segment's rows of a table beside the log, a folder for each ``day``."""
    (
        rows.hint("rebalance", "day")
        .write.partitionBy("day")
        .parquet(f"{root}/{table}/segment={segment}")
    )


def with_beside(
    spark: SparkSession, root: str, entries: list[Entry], tables: tuple[str, ...]
) -> list[Entry]:
    """A new segment's entries with the tables that were staged beside them."""
    found = {}
    for table in tables if entries else ():
        found[table] = set(names_in(spark, f"{root}/{table}/segment={entries[0].segment}"))
    return [
        replace(
            e,
            beside=tables,
            bare=tuple(t for t in tables if f"day={e.day or NO_DAY}" not in found[t]),
        )
        for e in entries
    ]


def scan_beside(
    spark: SparkSession,
    found: Snapshot,
    table: str,
    schema: T.StructType,
    made_of: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The rows of a table beside the log; segments that lack it have theirs made of the log."""
    have = tuple(e for e in found.entries if table in e.beside)
    lack = tuple(e for e in found.entries if table not in e.beside)
    rows = scan_segments(spark, replace(found, entries=have), table, "day", schema)
    if lack:
        own = made_of(scan_log(spark, replace(found, entries=lack))).select(*schema.names)
        rows = own.union(rows) if have else own
    return rows


def extra_types(columns: T.StructType) -> dict[str, str]:
    """The columns of a segment that the declared schema lacks."""
    return {f.name: f.dataType.simpleString() for f in columns if f.name not in STORED_LOG.names}


def without_batch(found: Snapshot, batch: int) -> Snapshot:
    """The list when a batch is gone."""
    stay = [left for e in found.entries if (left := e.without(batch))]
    return replace(found, entries=tuple(stay))


def compact(
    spark: SparkSession,
    root: str,
    beside: Mapping[str, T.StructType] | None = None,
    stage_words: Callable[[str, list[Entry]], list[Entry]] | None = None,
) -> Snapshot:
    """Merges the days that more than one segment holds, or that hide rows, into one folder
    each; other days stay as they are, so the work grows with what was added since.

    Rows and their order (by batch, then ``seq``) are the same before and after. Columns that
    uploads had beyond the declared ones are kept; one of several types becomes text.
    ``beside`` names the tables beside the log whose rows are merged too, where all of the
    merged entries have them; ``stage_words`` writes the filters of the rows likewise.
    """
    found = snapshot(spark, root)
    of_day: dict[str | None, list[Entry]] = {}
    for e in found.entries:
        of_day.setdefault(e.day, []).append(e)
    worn = {day for day, es in of_day.items() if len(es) > 1 or es[0].hidden}
    if not worn:
        return found
    taken = replace(found, entries=tuple(e for e in found.entries if e.day in worn))
    segment = new_segment()
    parts = [
        _as_text(_scan_with(spark, part, fields), odd)
        for part, fields, odd in _by_columns(taken)
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    entries = stage_log(merged, root, segment)
    kept = tuple(t for t in beside or {} if all(t in e.beside for e in taken.entries))
    for table in kept:
        rows = scan_segments(spark, taken, table, "day", beside[table])
        stage_beside(rows, table, root, segment)
    if stage_words is not None and all(e.words for e in taken.entries):
        entries = stage_words(segment, entries)
    stay = tuple(e for e in found.entries if e.day not in worn)
    extra = found.extra | {segment: extra_types(merged.schema)}
    live = {e.segment for e in stay} | {segment}
    return switch(
        spark,
        replace(
            found,
            entries=stay + tuple(with_beside(spark, root, entries, kept)),
            extra={s: columns for s, columns in extra.items() if s in live and columns},
        ),
    )


def _scan_with(spark: SparkSession, found: Snapshot, fields: dict[str, str]) -> DataFrame:
    extra = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    return scan_log(spark, found, extra)


def _by_columns(found: Snapshot) -> list[tuple[Snapshot, dict[str, str], set[str]]]:
    """The entries by the further columns that their segments have, and those of these
    columns that other segments hold with another type."""
    kinds: dict[str, set[str]] = {}
    for segment in {e.segment for e in found.entries}:
        for name, kind in found.extra.get(segment, {}).items():
            kinds.setdefault(name, set()).add(kind)
    odd = {name for name, found_kinds in kinds.items() if len(found_kinds) > 1}
    groups: dict[tuple, list[Entry]] = {}
    for e in found.entries:
        columns = tuple(sorted(found.extra.get(e.segment, {}).items()))
        groups.setdefault(columns, []).append(e)
    return [
        (replace(found, entries=tuple(es)), dict(columns), odd & dict(columns).keys())
        for columns, es in groups.items()
    ]


def _as_text(rows: DataFrame, names: set[str]) -> DataFrame:
    return rows.withColumns({n: F.col(f"`{n}`").cast("string") for n in sorted(names)})


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes all but the newest ``keep`` versions, and what none of those lists: merged and
    replaced segments, and what killed writes left. Not while a batch is being written."""
    names = [n for n in names_in(spark, f"{root}/{VERSIONS}") if n[0].isdigit()]
    live: set[str] = set()
    for name in names[-keep:]:
        found = snapshot(spark, root, int(name.split(".")[0]))
        live |= {e.segment for e in found.entries}
        live |= set(found.adjustments.values())
    for name in names[:-keep]:
        remove(spark, f"{root}/{VERSIONS}/{name}")
    for table in ("log", "cube", "idle", "firsts", "adjustments", "words"):
        for name in names_in(spark, f"{root}/{table}"):
            if name.startswith("segment=") and name.removeprefix("segment=") not in live:
                remove(spark, f"{root}/{table}/{name}")
