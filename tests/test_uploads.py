"""Uploads as people send them: order, dialect, headers, odd column names, old logs."""

import datetime as dt
import gzip
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import MINUTE, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.operators import cleaning, individual, overview, reports
from worklens.operators.cleaning import standardise_task_log
from worklens.sources import readers, uploads, writers
from worklens.sources.store import snapshot
from worklens.streaming.landing import ingest_landed


def put(folder, name, text, time):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (time, time))


def test_rows_follow_the_uploads_not_their_sizes(spark, tmp_path):
    """A small early file, a large later one cut into many splits, and one by name."""
    put(tmp_path / "in", "z.csv", "protocol_id\nsmall\n", 1000)
    put(tmp_path / "in", "a.csv", "protocol_id\n" + "".join(f"{i}\n" for i in range(4000)), 2000)
    put(tmp_path / "in", "b.csv", "protocol_id\nlast\n", 2000)
    dialect = uploads.CsvDialect(multi_line=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = readers.scan_export(spark, str(tmp_path / "in"), dialect=dialect)
        got = log.orderBy("seq").select("seq", "protocol_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = ["small", *map(str, range(4000)), "last"]
    assert [tuple(r) for r in got] == list(enumerate(want))


@pytest.mark.parametrize("files_per_batch", [1, 2, 1000])
def test_first_rows_do_not_depend_on_the_batches(spark, tmp_path, files_per_batch):
    head = "protocol_id,analyst,queue,duration,outcome\n"
    put(tmp_path / "in", "z.csv", head + "P1,ana,Q,00:10:00,WITHDRAWN\n", 1000)
    more = "P1,bob,Q,00:10:00,REGISTERED\n" * 50
    put(tmp_path / "in", "a.csv", head + more, 2000)
    paths = [str(tmp_path / p) for p in ("in", "log", "checkpoint")]
    ingest_landed(spark, *paths, files_per_batch=files_per_batch)
    summary = overview.queue_summary(readers.scan_task_log(spark, paths[1]))
    assert rows(summary.filter("part = 'handled'"), "queue", "out_of_scope") == [("Q", 1)]


def test_quotes_and_line_breaks(spark, tmp_path):
    put(tmp_path / "in", "a.csv", 'protocol_id;justification\n1;"two\nlines; ""q"""\n2;plain\n', 1)
    dialect = uploads.CsvDialect(sep=";")
    log = readers.scan_export(spark, str(tmp_path / "in"), dialect=dialect)
    assert rows(log, "protocol_id", "justification") == [
        ("1", 'two\nlines; "q"'), ("2", "plain"),
    ]
    writers.write_columns(log, ["protocol_id", "justification"], str(tmp_path / "out"), dialect)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '""q""' in text
    back = readers.scan_export(spark, str(tmp_path / "out"), dialect=dialect)
    assert rows(back, "justification") == rows(log, "justification")


def test_other_encodings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("protocol_id,queue\n1,AÇÃO\n".encode("latin-1"))
    log = readers.scan_export(
        spark, str(tmp_path / "in"), dialect=uploads.CsvDialect(encoding="ISO-8859-1")
    )
    assert rows(log, "queue") == [("AÇÃO",)]


def test_headers_differ(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "analyst,protocol_id\nana,P1\n", 1)
    put(tmp_path / "in", "b.csv", "protocol_id,analyst,note\nP2,bob,n\n", 2)
    put(tmp_path / "in", "c.csv", "protocol_id\nP3\n", 3)
    put(tmp_path / "in", "d.csv", "", 4)
    log = readers.scan_export(spark, str(tmp_path / "in"))
    got = log.orderBy("seq").select("seq", "protocol_id", "analyst", "x_note").collect()
    assert [tuple(r) for r in got] == [
        (0, "P1", "ana", None), (1, "P2", "bob", "n"), (2, "P3", None, None),
    ]


def test_headers_with_line_breaks(spark, tmp_path):
    put(tmp_path / "in", "a.csv", '"protocol_id","a\nb ""c"""\nP1,x\n', 1)
    put(tmp_path / "in", "b.csv", '"a\nb ""c""",protocol_id\ny,P2\n', 2)
    log = readers.scan_export(spark, str(tmp_path / "in"))
    assert rows(log, "seq", "protocol_id", 'x_a\nb "c"') == [(0, "P1", "x"), (1, "P2", "y")]


def test_a_long_header(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(uploads, "HEADER_BYTES", 16)
    put(tmp_path / "in", "a.csv", "protocol_id," + "n" * 300 + "\r\nP1,x\r\n", 1)
    path = str(tmp_path / "in" / "a.csv")
    assert uploads.first_record(spark, path, uploads.COMMA) == "protocol_id," + "n" * 300
    assert rows(readers.scan_export(spark, path), "protocol_id", "x_" + "n" * 300) == [("P1", "x")]


def test_zipped_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "protocol_id,analyst\n1,ana\n"), ("b", "protocol_id,analyst\n2,bob\n")):
        path = tmp_path / "in" / f"{name}.csv.gz"
        path.write_bytes(gzip.compress(text.encode()))
        os.utime(path, (1000, 1000))
    files = uploads.files_at(spark, str(tmp_path / "in"))
    assert len(uploads._by_header(spark, files, uploads.COMMA)) == 1
    log = readers.scan_export(spark, str(tmp_path / "in"))
    assert rows(log, "seq", "protocol_id", "analyst") == [(0, "1", "ana"), (1, "2", "bob")]


def test_numbering_moves_no_row(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "protocol_id\n1\n2\n", 1)
    text = plan(readers.scan_export(spark, str(tmp_path / "in")))
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_an_empty_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / p) for p in ("in", "log", "checkpoint")]
    ingest_landed(spark, *paths)
    assert readers.scan_task_log(spark, paths[1]).count() == 0
    assert readers.scan_export(spark, paths[0]).count() == 0


def test_a_batch_written_again_replaces_all_its_days(spark, tmp_path, make_log):
    from worklens.plans.cube import scan_stored_cube

    root = str(tmp_path / "log")

    def state():
        stored = readers.scan_task_log(spark, root)
        cube = scan_stored_cube(spark, snapshot(spark, root))
        total = cube.agg(F.sum("n")).first()[0] or 0
        return rows(stored, "batch", "completed_date"), total

    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    three = make_log(*[{"completed_at": d} for d in days])
    other = make_log({"completed_at": days[0]})
    writers.write_task_log(other, 7, root, with_cube=True)
    writers.write_task_log(three, 0, root, with_cube=True)
    assert len(state()[0]) == 4 and state()[1] == 4
    writers.write_task_log(make_log({"completed_at": days[1]}), 0, root, with_cube=True)
    assert state() == ([(0, days[1].date()), (7, days[0].date())], 2)
    writers.write_task_log(make_log(), 0, root, with_cube=True)
    assert state() == ([(7, days[0].date())], 1)


def test_durations_of_any_type(spark):
    kinds = {
        "text": "'0 days 00:10:00'",
        "interval": "INTERVAL '10' MINUTE",
        "nanoseconds": f"{10 * MINUTE * 1000}L",
    }
    for sql in kinds.values():
        raw = spark.sql(f"SELECT 1L AS seq, {sql} AS duration, {sql} AS analysis")
        unit = "ns" if sql.endswith("L") else None
        assert rows(standardise_task_log(raw, unit), "duration_us", "analysis_us") == [
            (10 * MINUTE,) * 2
        ]
    seconds = spark.sql("SELECT 600 AS duration")
    assert rows(standardise_task_log(seconds, "s"), "duration_us") == [(10 * MINUTE,)]
    with pytest.raises(ValueError, match="duration_unit"):
        standardise_task_log(spark.sql("SELECT 600 AS duration"))
    with pytest.raises(TypeError):
        standardise_task_log(spark.sql("SELECT true AS duration"))


def test_a_log_stored_with_nanoseconds(spark, tmp_path):
    when = dt.datetime(2024, 1, 10, 12, 30, 15, 123456)
    before = dt.datetime(1969, 12, 31, 23, 59, 59)
    table = pa.table(
        {
            "protocol_id": ["1", "2"],
            "duration": pa.array([dt.timedelta(minutes=10), None], pa.duration("ns")),
            "completed_at": pa.array([when, before], pa.timestamp("ns")),
        }
    )
    path = str(tmp_path / "old.parquet")
    pq.write_table(table, path)
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "false")
    with pytest.raises(ValueError, match="nanosAsLong"):
        readers.scan_legacy_log(spark, path)
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        log = readers.scan_legacy_log(spark, path)
        assert rows(log, "protocol_id", "duration_us", "completed_at") == [
            ("1", 10 * MINUTE, when), ("2", None, before),
        ]
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")


CAPTURED = ("day", "n", "month", "dur_s", "timed", "over_doubt_limit", "batch", "completed_date")


def test_columns_of_uploads_are_never_taken_for_ours(spark, tmp_path, make_log):
    log = make_log({"minutes": 30}, {"minutes": 40, "queue": "AUDIT", "outcome": "AUDITED"})
    odd = log.selectExpr("*", *[f"'2030-05-05' AS `{c}`" for c in CAPTURED])
    odd = standardise_task_log(odd)
    plain = standardise_task_log(log)
    for operator in (
        overview.overview_kpis, overview.daily_productivity, overview.monthly_tmo,
        overview.queue_summary, overview.daily_tmo, individual.analyst_metrics,
        individual.daily_task_count, reports.data_question_aggregates,
    ):
        assert rows(operator(odd)) == rows(operator(plain)), operator.__name__
    writers.write_task_log(odd, 3, str(tmp_path / "log"))
    extra = T.StructType([T.StructField(f"x_{c}", T.StringType()) for c in CAPTURED])
    stored = readers.scan_task_log(spark, str(tmp_path / "log"), extra)
    assert rows(stored, "completed_date", "batch", "x_day", "x_batch") == [
        (dt.date(2024, 1, 10), 3, "2030-05-05", "2030-05-05")
    ] * 2
    assert rows(overview.daily_productivity(stored)) == rows(overview.daily_productivity(plain))


def test_listed_tables_come_in_order(make_log):
    log = make_log(
        *[{"queue": "B", "cause": "c2", "deviations": "x, y"}] * 3,
        *[{"queue": "A", "cause": "c1", "deviations": "x"}] * 2,
        {"queue": "C", "cause": "c3"},
    )
    assert [r.queue for r in individual.queue_counts(log).collect()] == ["B", "A", "C"]
    assert [r.cause for r in individual.cause_counts(log).collect()] == ["c2", "c1", "c3"]
    assert [r.queue for r in individual.analyst_queue_tmo(log).collect()] == ["B", "A", "C"]
    assert [r.deviation for r in overview.deviation_counts(log).collect()] == ["x", "y"]


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    writers.write_task_log(make_log({}, {"protocol_id": None}), 0, root)
    log = readers.scan_task_log(spark, root)
    assert "SortAggregate" not in plan(overview.queue_summary(log))
    card = reports.team_card(log, dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    final = plan(card).split("+- == Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 3


def test_names_without_case(make_log):
    log = make_log({"analyst": "Ana"}, {"analyst": "ANA"}, {"analyst": "bob"})
    got = rows(reports.data_question_aggregates(log), "analyst", "tasks")
    assert sorted(got, key=str) == sorted([("ana", 2), ("bob", 1), (None, 3)], key=str)


def test_files_without_quotes_are_split(spark, tmp_path):
    """With the default dialect, which allows line breaks in quotes; rows stay in order."""
    put(tmp_path / "in", "a.csv", "protocol_id,analyst\n" + "".join(f"{i},ana\n" for i in range(4000)), 1000)
    put(tmp_path / "in", "b.csv", "protocol_id,analyst\nlast,\n", 2000)
    put(tmp_path / "quoted", "a.csv", 'protocol_id,analyst\n1,"two\nlines"\n\n2,bob\n', 1000)
    put(tmp_path / "ends", "a.csv", "protocol_id,analyst\r\n1,ana\r\n2,bob\r\n", 1000)
    put(tmp_path / "spaces", "a.csv", "protocol_id,analyst\n1,ana\n \n2,bob\n", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = readers.scan_export(spark, str(tmp_path / "in"))
        got = [tuple(r) for r in log.orderBy("seq").select("seq", "protocol_id").collect()]
        assert log.rdd.getNumPartitions() > 4
        assert got == list(enumerate([*map(str, range(4000)), "last"]))
        read = {
            name: rows(readers.scan_export(spark, str(tmp_path / name)), "protocol_id", "analyst")
            for name in ("quoted", "ends", "spaces")
        }
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert read["quoted"] == [("1", "two\nlines"), ("2", "bob")]
    assert read["ends"] == [("1", "ana"), ("2", "bob")]
    assert len(read["spaces"]) == 3


QUOTED = {
    "breaks": "protocol_id,analyst\n" + "".join(f'{i},"a\n\n{"x" * (i % 90)}""{i}"",\n"\n\n' for i in range(900)),
    "long": 'protocol_id,analyst\n1,"' + "two\n" * 9000 + 'end"\n2,"b"\n"3","","more"\n4\n5,""\n6,a"b"c\n',
    "returns": "protocol_id,analyst\r\n" + "".join(f'"{i}","é\n{i}\r\n"\r\n' for i in range(900)),
    "inside": "protocol_id,analyst\n" + "".join(f'{i},"\r{i}\r\n"\n' for i in range(900)),
    "unended": "protocol_id,analyst\n" + "".join(f'{i},"\n{i}"\n' for i in range(900)) + '"9","x\ny"',
    "header": '"protocol_id","the\nanalyst"\n' + "".join(f'{i},"\n{i}"\n' for i in range(900)),
    "never closed": 'protocol_id,analyst\n' + "".join(f'{i},"\n{i}"\n' for i in range(900)) + '1,"x\ny\n',
    "text after quotes": 'protocol_id,analyst\n' + "".join(f'{i},"\n{i}"\n' for i in range(900)) + '1,"x"y\n2,b\n',
    "blank": 'protocol_id,analyst\n' + "".join(f'{i},"\n{i}"\n' for i in range(900)) + ' \n2, "b"\n',
    "some returns": 'protocol_id,analyst\n' + "".join(f'{i},"\n{i}"\n' for i in range(900)) + '7,"b"\r\n8,c\r\n',
}
BY_RECORD = ("breaks", "long", "returns", "inside", "unended", "header")


@pytest.mark.parametrize("name", QUOTED)
def test_quoted_files_are_split_and_read_as_whole_ones(spark, tmp_path, name):
    """Records cross the splits, one of them several; odd files are read whole."""
    (tmp_path / "in").mkdir()
    files = [str(tmp_path / "in" / f) for f in ("a.csv", "b.csv")]
    for file, text in zip(files, (QUOTED[name], QUOTED["breaks"])):
        with open(file, "w", newline="") as out:
            out.write(text)
    header = uploads.first_record(spark, files[0], uploads.COMMA)
    group = files if header == "protocol_id,analyst" else files[:1]
    for time, file in enumerate(files):
        os.utime(file, (1000 + time, 1000 + time))
    whole = spark.read.options(header=True, **uploads.COMMA.options())
    want = [tuple(r) for f in group for r in whole.csv(f).collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        names = whole.csv(files[0]).columns
        placed = uploads._placed_by_record(spark, group, uploads.COMMA, names)
        blocks = placed.groupBy("_up_path").agg(F.countDistinct("_up_block").alias("n")).collect()
        got = [tuple(r) for r in uploads.number_rows(placed).orderBy("seq").drop("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    first = next(r.n for r in blocks if r._up_path.endswith("a.csv"))
    assert (first > 1) == (name in BY_RECORD)
