"""Every operator as a query over the given tables.

The task log and the unavailability intervals are derived by Spark from the
``events`` table, whole.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.workbook import workbook
from worklens.config import (
    DEFAULT,
    RECENT_ANALYST_TASKS_DAYS,
    RECENT_ANALYST_TMO_DAYS,
    RECENT_DAYS,
    RECENT_PRODUCTIVITY_DAYS,
)
from worklens.functions.sql import order_of
from worklens.operators import (
    cleaning,
    filters,
    idle,
    individual,
    overview,
    rankings,
    reports,
    unavailability,
)
from worklens.plans import cube, periods
from worklens.plans.first_tasks import scan_first_tasks
from worklens.plans.idle_cube import stored_idle
from worklens.session import shared_dir
from worklens.sources import readers, store, tenants, writers
from worklens.sources.events import (
    scan_events,
    task_log_from_events,
    unavailability_from_events,
)
from worklens.sources.files import order_times
from worklens.sources.uploads import COMMA, CsvDialect
from worklens.streaming.landing import ingest_landed

Query = Callable[[SparkSession, str], DataFrame]

FIRST, LAST = dt.date(2024, 1, 15), dt.date(2024, 2, 20)
BEFORE = (dt.date(2024, 1, 1), dt.date(2024, 2, 10))
AFTER = (dt.date(2024, 2, 1), dt.date(2024, 3, 31))
EXCLUDED = ["analyst_03", "analyst_07"]
CHOSEN = ["analyst_00", "analyst_01", "analyst_02", "analyst_05", "analyst_13_ter", "nobody"]
VOCABULARY = replace(DEFAULT, best_excluded="analyst_04")
#: Rows of a workbook, in the mean.
WORKBOOK_ROWS = 50_000
#: Rows of an uploaded CSV file, about, that one task sorts and writes.
UPLOAD_ROWS = 4_000_000


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_log_from_events(scan_events(spark, f"{sf_dir}/events.parquet"))


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_batch(raw_log(spark, sf_dir))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as an upload shows it: text durations and times, some of them unreadable."""
    log = raw_log(spark, sf_dir)
    clock = "format_string('%02d:%02d:%02d', {0}, s % 3600 div 60, s % 60)"
    with_days = f"concat(s div 86400, ' days ', {clock.format('s div 3600 % 24')})"

    def shown(time: str) -> str:
        t = f"CAST({time} AS STRING)"
        return (
            f"concat(substring({t}, 9, 2), '/', substring({t}, 6, 2), '/',"
            f" substring({t}, 1, 4), substring({t}, 11, 9))"
        )

    return log.selectExpr("*", "duration_us div 1000000 AS s").selectExpr(
        "seq",
        "protocol_id",
        "analyst",
        "status",
        "outcome",
        "queue",
        "CASE WHEN seq % 30 = 11 THEN 'not a time'"
        f" WHEN s IS NOT NULL AND seq % 2 = 0 THEN {with_days}"
        f" WHEN s IS NOT NULL THEN {clock.format('s div 3600')} END AS duration",
        "CASE WHEN seq % 40 = 13 THEN '31/02/2024 10:00:00'"
        f" ELSE {shown('completed_at')} END AS completed_at",
        "CASE WHEN seq % 40 = 14 THEN '2024-01-05 10:00:00'"
        f" ELSE {shown('started_at')} END AS started_at",
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unavailability_from_events(scan_events(spark, f"{sf_dir}/events.parquet"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, so that no lazily read result is overwritten."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"


def _halves(log: DataFrame) -> list[DataFrame]:
    """The finished tasks, and all others, those of unknown status among them."""
    finished = "coalesce(status = 'Finished', false)"
    return [log.filter(finished), log.filter(f"NOT {finished}")]


def scan_task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "scan")
    log = raw_log(spark, sf_dir).withColumns(
        {
            "protocol_id": F.col("protocol_id").cast("string"),
            "batch": F.lit(0),
            "completed_date": F.to_date("completed_at"),
        }
    )
    entries = store.stage_log(log, path, "s0")
    store.switch(spark, store.Snapshot(path, entries=tuple(entries)))
    return readers.scan_task_log(spark, path).select(
        "seq", "protocol_id", "analyst", "outcome", "queue", "duration_us", "justification"
    )


def append_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = raw_log(spark, sf_dir)
    columns = ["seq", "analyst", "queue", "module", "cause"]
    stored, batch = (half.select(*columns) for half in _halves(log))
    return cleaning.append_batch(stored.drop("module"), batch.drop("cause"))


def standardise_task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = cleaning.standardise_task_log(raw_text(spark, sf_dir))
    return typed.select(
        "seq", "duration_us", "completed_at", "started_at", "module", "justification",
        "completed_date", "completed_month",
    )


def drop_listed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = raw_log(spark, sf_dir).select("seq", "analyst", "queue")
    wide = log.withColumns({" id nip ": F.lit("x"), "M.o.": F.col("seq")})
    return cleaning.drop_listed_columns(wide)


def clamp_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = cleaning.clamp_durations(raw_log(spark, sf_dir))
    return clamped.select("seq", "outcome", "duration_us")


def write_task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "write")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))
    for batch_no, batch in enumerate(_halves(log)):
        writers.write_task_log(batch, batch_no, f"{path}/log")
    return readers.scan_task_log(spark, f"{path}/log").select(
        "seq", "protocol_id", "analyst", "outcome", "duration_us", "completed_at",
        "completed_date", "batch",
    )


def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "export")
    writers.write_columns(raw_log(spark, sf_dir), ["seq", "analyst", "deviations"], path)
    return spark.read.csv(path, header=True, schema="seq string, analyst string, deviations string")


def scan_unavailability(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "unavailability")
    lines = intervals(spark, sf_dir).selectExpr(
        *[f"substring(CAST({c} AS STRING), 1, 16) AS {c}" for c in ("start_at", "end_at")]
    )
    lines.write.mode("overwrite").csv(path)
    return readers.scan_unavailability(spark, path)


def stored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview from cubes stored batch by batch."""
    path = _scratch(spark, "cube")
    log = clean_log(spark, sf_dir)
    for batch_no, batch in enumerate(_halves(log)):
        cube.add_to_cube(batch, batch_no, path)
    return overview.overview_kpis(cube.scan_cube(spark, path))


def ingest_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as files landing in a folder, cleaned and appended by a stream."""
    path = _scratch(spark, "landing")
    raw_text(spark, sf_dir).drop("seq").withColumn("ID NIP", F.lit("x")).write.mode(
        "overwrite"
    ).csv(f"{path}/in", header=True)
    ingest_landed(spark, f"{path}/in", f"{path}/log", f"{path}/checkpoint")
    return readers.scan_task_log(spark, f"{path}/log").select(
        "protocol_id", "analyst", "outcome", "duration_us", "completed_at", "started_at",
        "completed_date",
    )


def _uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_text(spark, sf_dir).withColumn("part", F.col("seq") % 10)


def _upload(
    rows: DataFrame, path: str, dialect: CsvDialect = COMMA, one_file: bool = False
) -> None:
    """One file in the order of ``seq``, or several one after another if there are many rows
    and ``one_file`` is not set; a later call's files have later times."""
    options = {k: v for k, v in dialect.options().items() if k != "multiLine"}
    rows = rows.drop("part")
    many = 1 if one_file else -(-rows.count() // UPLOAD_ROWS)
    if many > 1:
        ordered = rows.repartitionByRange(many, "seq").sortWithinPartitions("seq")
    else:
        ordered = rows.orderBy("seq").coalesce(1)
    ordered.drop("seq").write.options(header=True, **options).csv(path)
    if many > 1:
        order_times(rows.sparkSession, path)


def _landed(spark: SparkSession, path: str, **options) -> DataFrame:
    ingest_landed(spark, f"{path}/in/*", f"{path}/log", f"{path}/checkpoint", **options)
    return readers.scan_task_log(spark, f"{path}/log")


def ingest_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each protocol's first row by upload: a small file first, larger ones that repeat
    its protocols after it, over two batches."""
    path, rows = _scratch(spark, "many"), _uploaded(spark, sf_dir)
    for number, part in enumerate(("part = 9", "part < 6", "part IN (6, 7, 8)")):
        _upload(rows.filter(part), f"{path}/in/u{number}")
    log = _landed(spark, path, files_per_batch=2)
    place = order_of(log.columns)
    first = log.filter("protocol_id IS NOT NULL").selectExpr("*", f"{place} AS place")
    return first.groupBy("protocol_id").agg(
        F.expr("min_by(completed_at, place) AS first_completed_at"),
        F.expr("min_by(analyst, place) AS first_analyst"),
        F.count("*").alias("tasks"),
    )


def ingest_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their columns in another order, fewer of them, and new ones."""
    path, rows = _scratch(spark, "mixed"), _uploaded(spark, sf_dir)
    _upload(rows.filter("part < 3"), f"{path}/in/u0")
    turned = rows.select("seq", "part", "queue", "outcome", "analyst", "protocol_id", "status")
    _upload(turned.filter("part IN (3, 4, 5, 6)"), f"{path}/in/u1")
    more = rows.selectExpr("*", "concat('d', part) AS day", "part AS n").drop("queue")
    _upload(more.filter("part > 6"), f"{path}/in/u2")
    ingest_landed(spark, f"{path}/in/*", f"{path}/log", f"{path}/checkpoint")
    extra = T.StructType([T.StructField(f"x_{c}", T.StringType()) for c in ("day", "n")])
    return readers.scan_task_log(spark, f"{path}/log", extra).select(
        "seq", "protocol_id", "analyst", "outcome", "queue", "duration_us", "completed_date",
        "x_day", "x_n",
    )


def ingest_quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, separators and line breaks, separated by semicolons."""
    path, dialect = _scratch(spark, "quoted"), CsvDialect(sep=";")
    rows = _uploaded(spark, sf_dir).selectExpr(
        "seq", "part", "protocol_id", "analyst",
        "concat('said \"', status, '\"; then', chr(10), 'left, at ', part) AS justification",
    )
    _upload(rows, f"{path}/in/u0", dialect)
    return _landed(spark, path, dialect=dialect).select(
        "seq", "protocol_id", "analyst", "justification"
    )


def scan_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as workbook uploads, a file for each of Spark's partitions."""
    path = _scratch(spark, "workbooks")
    columns = ["protocol_id", "analyst", "status", "outcome", "queue"]
    rows = raw_log(spark, sf_dir).selectExpr(
        *columns, "duration_us", "date_trunc('second', completed_at) AS completed_at",
        "date_trunc('second', started_at) AS started_at",
    )

    def write(batches):
        table = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        names = [*columns, "duration", "completed_at", "started_at"]
        shown = [
            [*r[:5], None if r[5] is None else dt.timedelta(microseconds=r[5]), *map(naive, r[6:])]
            for r in table
        ]
        content = workbook({"log": [names, *shown]})
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{uuid.uuid4().hex}.xlsx") as out:
            out.write(content)
        yield pa.RecordBatch.from_arrays([pa.array([len(table)])], ["n"])

    def naive(time):
        return time and time.replace(tzinfo=None)

    # a workbook is written and read by one task
    files = max(4, -(-rows.count() // WORKBOOK_ROWS))
    rows.repartition(files, "protocol_id").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return readers.scan_export(spark, f"{path}/*").select(
        *columns, "duration_us", "completed_at", "started_at"
    )


def rewrite_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks per day of the log and of the cube, after one batch was written again with
    fewer days and another with no rows."""
    path = _scratch(spark, "rewrite")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))
    fewer = log.filter("day(completed_at) <= 10")
    for batch_no, batch in ((0, log), (1, log), (0, fewer), (1, log.filter("false"))):
        writers.write_task_log(batch, batch_no, path, with_cube=True)
    return _tasks_per_day(spark, store.snapshot(spark, path))


def _tasks_per_day(spark: SparkSession, found: store.Snapshot) -> DataFrame:
    per_day = {
        "log": store.scan_log(spark, found).selectExpr("completed_date AS day", "1L AS n"),
        "cube": cube.scan_stored_cube(spark, found).select("day", "n"),
    }
    counted = [
        rows.groupBy("day").agg(F.sum("n").alias("tasks")).selectExpr(f"'{name}' AS kept_in", "*")
        for name, rows in per_day.items()
    ]
    return counted[0].union(counted[1])


def swap_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks per day of the log and of the cube, as a snapshot taken before a batch was replaced
    still shows them, and as they are after it; the segment of a write that never switched
    is in neither."""
    path = _scratch(spark, "swap")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))
    for batch_no, batch in enumerate(_halves(log)):
        writers.write_task_log(batch, batch_no, path, with_cube=True)
    before = store.snapshot(spark, path)
    staged = log.withColumns({"batch": F.lit(9), "completed_date": F.to_date("completed_at")})
    store.stage_log(staged, path, store.new_segment())
    writers.write_task_log(log.filter("day(completed_at) <= 10"), 0, path, with_cube=True)
    shown = [
        _tasks_per_day(spark, found).selectExpr(f"'{name}' AS version", "*")
        for name, found in (("before", before), ("after", store.snapshot(spark, path)))
    ]
    return shown[0].union(shown[1])


def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log after its batches were merged into a base, one of them was replaced, all
    were merged again, and a last one came: rows with their places in the log's order, and
    how many tasks the cube has on their day."""
    path = _scratch(spark, "compact")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))

    def write(batch_no: int, rows: str) -> None:
        writers.write_task_log(log.filter(rows), batch_no, path, with_cube=True)

    for batch_no in range(3):
        write(batch_no, f"seq % 4 = {batch_no}")
    writers.compact_log(spark, path)
    write(1, "seq % 8 = 1")
    writers.compact_log(spark, path)
    write(0, "seq % 4 = 0 AND day(completed_at) <= 20")
    write(3, "seq % 4 = 3 AND day(completed_at) > 20")
    stored = readers.scan_task_log(spark, path)
    tasks = (
        cube.scan_stored_cube(spark, store.snapshot(spark, path))
        .groupBy(F.col("day").alias("completed_date"))
        .agg(F.sum("n").alias("tasks"))
    )
    return stored.join(tasks, "completed_date").select(
        "seq", "batch", "analyst", "outcome", "duration_us", "completed_date", "tasks"
    )


def filter_last_days_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest days of the stored log, known without a scan."""
    path = _scratch(spark, "latest")
    writers.write_task_log(raw_log(spark, sf_dir), 0, path)
    return readers.scan_last_days(spark, path, RECENT_DAYS).select("seq", "completed_at")


def cube_idle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle time from the summaries of batches of which two interleave."""
    path = _scratch(spark, "idle")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))
    splits = ("day(completed_at) <= 10", "seq % 2 = 0", "seq % 2 = 1")
    for batch_no, rows in enumerate(splits):
        chosen = rows if batch_no == 0 else f"NOT ({splits[0]}) AND {rows}"
        writers.write_task_log(log.filter(chosen), batch_no, path, with_idle=True)
    return idle.idle_time_daily(stored_idle(spark, store.snapshot(spark, path)))


def team_card_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team card of the stored log, from its cube and its summaries of idle time."""
    path = _scratch(spark, "card")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))
    writers.write_task_log(log, 0, path, with_cube=True, with_idle=True)
    found = store.snapshot(spark, path).between(FIRST, LAST)
    return reports.team_card(
        store.scan_log(spark, found), FIRST, LAST, cube=cube.scan_stored_cube(spark, found),
        idle_days=stored_idle(spark, found, FIRST, LAST),
    )


def queue_summary_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue summary from the cube and the first tasks, after a batch was replaced."""
    path = _scratch(spark, "firsts")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))
    for batch_no, rows in ((1, "seq >= 700"), (0, "seq % 3 = 0"), (0, "seq < 700")):
        writers.write_task_log(
            log.filter(rows), batch_no, path, with_cube=True, with_firsts=True
        )
    found = store.snapshot(spark, path)
    return overview.queue_summary(
        cube.scan_stored_cube(spark, found), firsts=scan_first_tasks(spark, found)
    )


def many_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve overlapping periods from each day with tasks on."""
    log = clean_log(spark, sf_dir)
    days = log.selectExpr("to_date(completed_at) AS first_day").distinct()
    ends = "explode(transform(sequence(0, 11), w -> date_add(first_day, 9 * w))) AS last_day"
    return periods.many_periods(log, days.selectExpr("first_day", ends))


def tenant_productivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily productivity of two of three tenants, from a store of each."""
    path = _scratch(spark, "tenants")
    log = raw_log(spark, sf_dir).withColumn("protocol_id", F.col("protocol_id").cast("string"))
    tenants.write_tenants(log.withColumn("tenant", F.expr("concat('t', seq % 3)")), 0, path)
    chosen = log.selectExpr("concat('t', seq % 3) AS name").where("name <> 't1'").distinct()
    return tenants.for_each_tenant(
        spark, path, lambda found: overview.daily_productivity(store.scan_log(spark, found)), chosen
    )


def ingest_repeated_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export, one that repeats part of it beside new rows, and the first one again."""
    path, rows = _scratch(spark, "again"), _uploaded(spark, sf_dir)
    for number, part in enumerate(("part < 6", "part > 3", "part < 6")):
        _upload(rows.filter(part), f"{path}/in/u{number}", one_file=True)
    log = _landed(spark, path, files_per_batch=1, new_rows_only=True)
    return log.groupBy("batch", "analyst").agg(
        F.count("*").alias("tasks"), F.count("protocol_id").alias("protocols"),
        F.sum("duration_us").alias("duration_us"),
    )


def scan_legacy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with times and durations in whole nanoseconds."""
    path = _scratch(spark, "legacy")
    nanos = "(unix_date(to_date({0})) * 86400L + hour({0}) * 3600 + minute({0}) * 60 + second({0}))"
    raw_log(spark, sf_dir).selectExpr(
        "seq", "protocol_id", "analyst", "duration_us * 1000 AS duration",
        *[f"{nanos.format(c)} * 1000000000 AS {c}" for c in ("completed_at", "started_at")],
    ).write.parquet(path)
    return readers.scan_legacy_log(spark, path).select(
        "seq", "duration_us", "completed_at", "started_at"
    )


def period_from_stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's period read from the stored log: only its days' folders."""
    path = _scratch(spark, "stored")
    writers.write_task_log(raw_log(spark, sf_dir), 0, path)
    stored = readers.scan_task_log(spark, path, first=FIRST, last=LAST)
    return overview.daily_productivity(filters.filter_period(stored, FIRST, LAST))


def default_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.default_roster(raw_log(spark, sf_dir), EXCLUDED)


def filter_analysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = raw_log(spark, sf_dir)
    roster = filters.default_roster(log, EXCLUDED)
    return filters.filter_analysts(log, roster).select("seq", "analyst")


def queries() -> dict[str, Query]:
    def on(log: Callable[[SparkSession, str], DataFrame], run: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: run(log(spark, sf_dir))

    def raw(run):
        return on(raw_log, run)

    def clean(run):
        return on(clean_log, run)

    def rank(ranking: str) -> Query:
        return lambda spark, sf_dir: rankings.rank_by(
            clean_log(spark, sf_dir), ranking, filters.is_rostered(EXCLUDED)
        )

    return {
        # ingest, cleaning, sinks
        "scan_task_log": scan_task_log,
        "append_batch": append_batch,
        "standardise_task_log": standardise_task_log,
        "drop_listed_columns": drop_listed_columns,
        "exclude_robot_and_unassigned": raw(
            lambda log: cleaning.exclude_robot_and_unassigned(log).select("seq", "analyst")
        ),
        "clamp_durations": clamp_durations,
        "duration_adjustments": raw(cleaning.duration_adjustments),
        "write_task_log": write_task_log,
        "export_columns": export_columns,
        "scan_unavailability": scan_unavailability,
        "ingest_landing": ingest_landing,
        "ingest_many_files": ingest_many_files,
        "ingest_mixed_headers": ingest_mixed_headers,
        "ingest_quoted_text": ingest_quoted_text,
        "scan_workbook": scan_workbook,
        "rewrite_batch": rewrite_batch,
        "swap_batch": swap_batch,
        "compact_log": compact_log,
        "ingest_repeated_upload": ingest_repeated_upload,
        "scan_legacy_log": scan_legacy_log,
        "period_from_stored_log": period_from_stored_log,
        # filters, roster
        "filter_period": raw(
            lambda log: filters.filter_period(log, FIRST, LAST).select("seq", "completed_at")
        ),
        "filter_last_days": raw(
            lambda log: filters.filter_last_days(log, RECENT_DAYS).select("seq", "completed_at")
        ),
        "filter_last_days_stored": filter_last_days_stored,
        "tenant_productivity": tenant_productivity,
        "default_roster": default_roster,
        "filter_analysts": filter_analysts,
        "drop_doubt_outliers": raw(
            lambda log: filters.drop_doubt_outliers(log).select("seq", "queue", "duration_us")
        ),
        "filter_months": raw(
            lambda log: filters.filter_months(log, ["2024-01", "2024-03"]).select(
                "seq", "completed_at"
            )
        ),
        # overview
        "overview_kpis": clean(overview.overview_kpis),
        "queue_summary": clean(overview.queue_summary),
        "queue_summary_stored": queue_summary_stored,
        "production_by_group": clean(overview.production_by_group),
        "outcome_by_module": clean(overview.outcome_by_module),
        "email_group_detail": clean(overview.email_group_detail),
        "daily_productivity": clean(overview.daily_productivity),
        "daily_productivity_recent": clean(
            lambda log: filters.filter_last_days(
                overview.daily_productivity(log), RECENT_PRODUCTIVITY_DAYS, ()
            )
        ),
        "daily_registered_updated": clean(overview.daily_registered_updated),
        "daily_tmo": clean(overview.daily_tmo),
        "daily_tmo_closed": clean(overview.daily_tmo_closed),
        "daily_tmo_closed_zero_filled": clean(overview.daily_tmo_closed_zero_filled),
        "daily_tmo_registered": clean(overview.daily_tmo_registered),
        "monthly_tmo_by_outcome": clean(overview.monthly_tmo_by_outcome),
        "monthly_tmo_long": clean(
            lambda log: overview.monthly_tmo_long(overview.monthly_tmo_by_outcome(log))
        ),
        "monthly_tmo": clean(overview.monthly_tmo),
        "analyst_tmo": clean(overview.analyst_tmo),
        "deviation_counts": clean(overview.deviation_counts),
        "deviation_counts_real": clean(overview.deviation_counts_real),
        "top_deviation": clean(overview.top_deviation),
        # rankings
        "rank_overall": clean(rankings.rank_overall),
        "rank_updates": rank("updates"),
        "rank_registration": rank("registration"),
        "rank_pre_registration": rank("pre_registration"),
        "rank_official_letters": rank("official_letters"),
        "rank_agencies": rank("agencies"),
        "rank_audit": rank("audit"),
        "rank_distribution": rank("distribution"),
        "all_rankings": clean(rankings.all_rankings),
        "quartile_band": clean(
            lambda log: rankings.rank_overall(log, filters.is_rostered(EXCLUDED)).select(
                "position", "band"
            )
        ),
        "best_by_queue_tmo": clean(lambda log: rankings.best_by_queue_tmo(log, VOCABULARY)),
        "best_by_queue_volume": clean(lambda log: rankings.best_by_queue_volume(log, VOCABULARY)),
        "most_productive": clean(rankings.most_productive),
        # individual
        "analyst_metrics": clean(individual.analyst_metrics),
        "team_tmo": clean(individual.team_tmo),
        "analyst_vs_team": clean(individual.analyst_vs_team),
        "best_day_tmo": clean(individual.best_day_tmo),
        "best_day_volume": clean(individual.best_day_volume),
        "analyst_queue_tmo": clean(individual.analyst_queue_tmo),
        "queue_tmo_finished": clean(individual.queue_tmo_finished),
        "idle_time_daily": clean(idle.idle_time_daily),
        "idle_time_mean": clean(idle.idle_time_mean),
        "idle_time_total": clean(idle.idle_time_total),
        "cube_idle_time": cube_idle_time,
        "analyst_monthly_tmo": clean(individual.analyst_monthly_tmo),
        "analyst_monthly_tmo_long": clean(
            lambda log: overview.monthly_tmo_long(individual.analyst_monthly_tmo(log), ["analyst"])
        ),
        "daily_tmo_by_analyst_recent": clean(
            lambda log: filters.filter_last_days(
                overview.daily_tmo(log, ["analyst"]), RECENT_ANALYST_TMO_DAYS, ["analyst"]
            )
        ),
        "daily_task_count": clean(individual.daily_task_count),
        "daily_task_count_recent": clean(
            lambda log: filters.filter_last_days(
                individual.daily_task_count(log), RECENT_ANALYST_TASKS_DAYS, ["analyst"]
            )
        ),
        "queue_counts": clean(individual.queue_counts),
        "cause_counts": clean(individual.cause_counts),
        "portfolio_status_counts": clean(individual.portfolio_status_counts),
        "portfolio_tmo": clean(individual.portfolio_tmo),
        "points_of_attention": clean(individual.points_of_attention),
        # period reports
        "period_summary": clean(lambda log: reports.period_summary(log, FIRST, LAST, CHOSEN)),
        "period_summary_band": clean(
            lambda log: reports.period_summary_band(
                reports.period_summary(log, FIRST, LAST, CHOSEN, registered_only=True)
            ).select("analyst", "tmo_s", "tasks", "band")
        ),
        "cause_by_analyst": clean(lambda log: reports.cause_by_analyst(log, FIRST, LAST, CHOSEN)),
        "period_registered_updated": clean(
            lambda log: reports.period_registered_updated(log, FIRST, LAST, CHOSEN)
        ),
        "analyst_daily_detail": clean(
            lambda log: reports.analyst_daily_detail(log, FIRST, LAST, CHOSEN)
        ),
        "period_full_summary": clean(
            lambda log: reports.period_full_summary(log, FIRST, LAST, CHOSEN)
        ),
        "period_comparison": clean(lambda log: reports.period_comparison(log, BEFORE, AFTER)),
        "registration_report": clean(lambda log: reports.registration_report(log, FIRST, LAST)),
        "analyst_scorecard": clean(lambda log: reports.analyst_scorecard(log, FIRST, LAST)),
        "team_card": clean(lambda log: reports.team_card(log, FIRST, LAST)),
        "team_card_stored": team_card_stored,
        "many_periods": many_periods,
        "data_question_aggregates": clean(reports.data_question_aggregates),
        # unavailability
        "unavailability_daily": on(intervals, unavailability.unavailability_daily),
        "unavailability_covered": on(intervals, unavailability.unavailability_covered),
        "unavailability_share": on(
            intervals,
            lambda df: unavailability.unavailability_share(
                df, dt.date(2024, 1, 10), dt.date(2024, 1, 20)
            ),
        ),
        # the same operators over the pre-aggregated log
        "cube_overview_kpis": clean(lambda log: overview.overview_kpis(cube.activity_cube(log))),
        "cube_stored_overview_kpis": stored_cube,
        "cube_rank_overall": clean(lambda log: rankings.rank_overall(cube.activity_cube(log))),
        "cube_analyst_metrics": clean(
            lambda log: individual.analyst_metrics(cube.activity_cube(log))
        ),
    }
