import datetime as dt
from types import SimpleNamespace

import pytest
from conftest import MINUTE, rows
from pyspark.sql import types as T

from worklens.operators.cleaning import standardise_task_log
from worklens.schema import PORTUGUESE_HEADERS
from worklens.session import shared_dir
from worklens.sources import readers, writers
from worklens.sources.store import snapshot
from worklens.streaming.landing import ingest_landed

HEADER = "ID NIP,NÚMERO DO PROTOCOLO,USUÁRIO QUE CONCLUIU A TAREFA,FINALIZAÇÃO," \
         "TEMPO MÉDIO OPERACIONAL,DATA DE CONCLUSÃO DA TAREFA\n"
LINES = [
    "x,1,ana,REGISTERED,00:05:00,10/01/2024 10:00:00\n",
    "x,2,Robot_Hub,REGISTERED,00:05:00,10/01/2024 10:00:00\n",
    "x,3,bob,UPDATED,00:05:00,11/01/2024 10:00:00\n",
    "x,4,bob,UPDATED,soon,never\n",
]
STORED = [("1", "ana", 20 * MINUTE, dt.date(2024, 1, 10)), ("3", "bob", 5 * MINUTE,
          dt.date(2024, 1, 11)), ("4", "bob", None, None)]


def upload(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(HEADER + "".join(lines), encoding="utf-8")


def stored(spark, path):
    log = readers.scan_task_log(spark, str(path))
    return rows(log, "protocol_id", "analyst", "duration_us", "completed_date")


def adjustments(spark, root, batch):
    return f"{root}/adjustments/segment={snapshot(spark, root).adjustments[batch]}"


def test_nothing_stored_yet(spark, tmp_path):
    log = readers.scan_task_log(spark, str(tmp_path / "none"))
    assert log.count() == 0 and "justification" in log.columns


def test_upload_write_and_repeat(spark, tmp_path):
    upload(tmp_path / "in.csv", *LINES)
    log = str(tmp_path / "log")
    batch = readers.scan_export(spark, str(tmp_path / "in.csv"), PORTUGUESE_HEADERS)
    assert "ID NIP" not in batch.columns
    for _ in range(2):
        assert writers.write_task_log(batch, 1, log) is True
        assert stored(spark, log) == STORED
    logged = spark.read.option("header", True).csv(adjustments(spark, log, 1))
    assert rows(logged) == [("1", "REGISTERED", str(5 * MINUTE), str(20 * MINUTE))]
    upload(tmp_path / "more.csv", LINES[2].replace(",3,", ",9,"))
    more = readers.scan_export(spark, str(tmp_path / "more.csv"), PORTUGUESE_HEADERS)
    assert writers.write_task_log(more, 2, log) is False
    assert len(stored(spark, log)) == 4
    assert rows(readers.scan_adjustments(spark, log)) == [
        (1, "1", "REGISTERED", 5 * MINUTE, 20 * MINUTE)
    ]
    message = spark.read.text(adjustments(spark, log, 2)).first()[0]
    assert message == writers.NO_ADJUSTMENT


def test_a_batch_without_rows(spark, tmp_path, make_log):
    log = str(tmp_path / "log")
    empty = make_log({"analyst": None})
    assert writers.write_task_log(empty, 0, log) is False
    assert writers.write_task_log(make_log(), 1, log) is False
    assert spark.read.text(adjustments(spark, log, 0)).count() == 1
    assert writers.write_task_log(make_log({}), 2, log) is False
    assert readers.scan_task_log(spark, log).count() == 1


def test_columns_we_do_not_know_are_kept(spark, tmp_path, make_log):
    path = str(tmp_path / "log")
    for batch_no, batch in enumerate((make_log({}), make_log({}).selectExpr("*", "'hi' AS `a b`"))):
        writers.write_task_log(batch, batch_no, path)
    assert "x_a b" not in readers.scan_task_log(spark, path).columns
    extra = T.StructType([T.StructField("x_a b", T.StringType())])
    assert rows(readers.scan_task_log(spark, path, extra), "batch", "x_a b") == [(0, None), (1, "hi")]


def test_day_partitions_are_pruned(spark, tmp_path, make_log):
    log = make_log({}, {"completed_at": dt.datetime(2024, 2, 1)})
    writers.write_task_log(log, 0, str(tmp_path / "log"))
    one = readers.scan_task_log(spark, str(tmp_path / "log")).filter(
        "completed_date = '2024-02-01'"
    )
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(completed_date" in plan
    assert one.count() == 1


def test_landing_folder_takes_each_file_once(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("in", "log", "checkpoint")]
    upload(tmp_path / "in" / "a.csv", *LINES)
    for _ in range(2):
        ingest_landed(spark, *paths, headers=PORTUGUESE_HEADERS)
        assert stored(spark, paths[1]) == STORED
    upload(tmp_path / "in" / "b.csv", LINES[0].replace(",1,", ",7,"))
    ingest_landed(spark, *paths, headers=PORTUGUESE_HEADERS)
    got = readers.scan_task_log(spark, paths[1])
    assert [r.protocol_id for r in got.orderBy("batch", "seq").collect()] == ["1", "3", "4", "7"]


def test_export(spark, tmp_path, make_log):
    log = make_log({"queue": None}, {})
    writers.write_columns(log, ["seq", "queue"], str(tmp_path / "out"))
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert rows(got) == [("0", None), ("1", "INCIDENT")]


def test_unavailability_lines(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("2024-01-10 08:00,2024-01-10 09:30\nbad,2024-01-10 10:00\n")
    got = readers.scan_unavailability(spark, str(tmp_path / "lines.txt"))
    assert rows(got) == [
        (dt.datetime(2024, 1, 10, 8), dt.datetime(2024, 1, 10, 9, 30)),
        (None, dt.datetime(2024, 1, 10, 10)),
    ]


def test_typed_columns_pass_through(make_log):
    log = make_log({"minutes": 10})
    assert rows(standardise_task_log(log), "seq", "duration_us", "completed_at") == [
        (0, 10 * MINUTE, dt.datetime(2024, 1, 10, 12))
    ]


def session(master, **conf):
    context = SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: conf)
    get = lambda key, default=None: conf.get(key, default)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=get))


def test_shared_dir_is_the_one_the_session_names():
    named = session("spark://host", **{"spark.checkpoint.dir": "/some/shared/"})
    assert shared_dir(named) == "/some/shared/worklens-app-1"
    unnamed = session("spark://host", **{"spark.sql.warehouse.dir": "/some/warehouse"})
    assert shared_dir(unnamed) == "/some/warehouse/worklens-app-1"


def test_declared_schema():
    assert "completed_at:timestamp_ntz" in readers.STORED_LOG.simpleString()
