"""Workbook uploads: cells of every kind, sheets, headers, and their place among other uploads."""

import datetime as dt
import os

import pytest
from conftest import MINUTE, rows

from checks.workbook import letters, workbook
from worklens.schema import PORTUGUESE_HEADERS
from worklens.sources import readers, workbooks
from worklens.streaming.landing import ingest_landed

NOON = dt.datetime(2024, 1, 10, 12, 30, 15)


def put(folder, name, sheets, time=1000, **options):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(workbook(sheets, **options))
    os.utime(folder / name, (time, time))


def test_cells():
    made = [
        [None, "text", 7, 2.5, True, NOON, dt.timedelta(days=1, minutes=5), dt.timedelta(milliseconds=1500)],
        [],
        [("t='inlineStr'", "<is><r><t>in </t></r><r><t>line</t></r><rPh><t>aid</t></rPh></is>"),
         ("t='str'", "<f>1+1</f><v>made</v>"), ("t='e'", "<v>#N/A</v>"), ("s='3'", "<v>3</v>"),
         ("s='4'", "<v>1</v>"), ("s='4'", "<v>61</v>"), ("s='2'", "<v>-1</v>"), ("s='1'", "<v>1e9</v>"),
         ("", "<v>12345678901234567890</v>"), ("", ""), " <&> "],
    ]
    got = list(workbooks.Workbook(workbook({"a": made})).rows())
    assert got == [
        {1: "text", 2: "7", 3: "2.5", 4: "TRUE", 5: "10/01/2024 12:30:15", 6: "1 days 00:05:00",
         7: "0 days 00:00:01.500"},
        {0: "in line", 1: "made", 3: "3", 4: "01/01/1900 00:00:00", 5: "01/03/1900 00:00:00",
         8: "12345678901234567890", 10: " <&> "},
    ]


@pytest.mark.parametrize("from_1904", [False, True])
def test_days_to_the_second(from_1904):
    times = [dt.datetime(2024, 2, 29, 23, 59, 59) + dt.timedelta(seconds=i * 86_399) for i in range(200)]
    made = workbook({"a": [[t] for t in times]}, from_1904)
    assert [r[0] for r in workbooks.Workbook(made).rows()] == [f"{t:%d/%m/%Y %H:%M:%S}" for t in times]


@pytest.mark.parametrize(
    "code, kind",
    [("General", "number"), ("0.00", "number"), ("dd/mm/yyyy", "day"), ("mmmm", "day"), ("h:mm", "time"),
     ("[h]:mm:ss", "time"), ("[mm]:ss", "time"), ("[Red]0", "number"), ('0 "days"', "number"),
     ("[$-409]d-mmm-yy", "day"), ("hh:mm:ss;@", "time"), ("0\\d", "number")],
)
def test_number_formats(code, kind):
    assert workbooks._kind_of(code) == kind


def test_letters():
    for column in (0, 25, 26, 701, 702, 16383):
        assert workbooks._column_of(f"{letters(column)}12") == column


def test_sheets_and_headers(spark, tmp_path):
    put(tmp_path / "in", "a.xlsx", {
        "notes": [["protocol_id"], ["0"]],
        "log": [[], ["protocol_id", "note", None, "note", "empty"], ["1", "x", "y", "z"], [], [None, "w"]],
    })
    path = str(tmp_path / "in" / "a.xlsx")
    found = workbooks.placed_workbooks(spark, [path], "log").orderBy("_up_place")
    assert [tuple(r) for r in found.select("protocol_id", "note", "_c2", "`note.1`", "empty").collect()] == [
        ("1", "x", "y", "z", None), (None, "w", None, None, None),
    ]
    assert rows(readers.scan_export(spark, path), "seq", "protocol_id") == [(0, "0")]
    put(tmp_path / "in", "none.xlsx", {"log": [["protocol_id"]]})
    put(tmp_path / "in", "bare.xlsx", {"log": []})
    only = [str(tmp_path / "in" / n) for n in ("none.xlsx", "bare.xlsx")]
    assert workbooks.placed_workbooks(spark, only) is None
    assert readers.scan_export(spark, only[0]).count() == 0


def test_workbooks_land_among_other_uploads(spark, tmp_path):
    head = ["NÚMERO DO PROTOCOLO", "USUÁRIO QUE CONCLUIU A TAREFA", "FINALIZAÇÃO",
            "TEMPO MÉDIO OPERACIONAL", "DATA DE CONCLUSÃO DA TAREFA", "ID NIP"]
    made = [head, [1, "ana", "REGISTERED", dt.timedelta(minutes=5), NOON, 3], [2, "Robot_Hub", "UPDATED"],
            [3, "bob", "UPDATED", dt.timedelta(minutes=5), NOON]]
    put(tmp_path / "in", "b.xlsx", {"x": made}, 2000)
    (tmp_path / "in" / "a.csv").write_text(",".join(head[:2]) + "\n9,eve\n")
    os.utime(tmp_path / "in" / "a.csv", (3000, 3000))
    paths = [str(tmp_path / p) for p in ("in", "log", "checkpoint")]
    ingest_landed(spark, *paths, headers=PORTUGUESE_HEADERS)
    log = readers.scan_task_log(spark, paths[1])
    assert rows(log, "seq", "protocol_id", "analyst", "duration_us", "completed_at") == [
        (0, "1", "ana", 20 * MINUTE, NOON), (2, "3", "bob", 5 * MINUTE, NOON), (3, "9", "eve", None, None),
    ]


def test_workbooks_are_taken_apart_once(spark, tmp_path):
    put(tmp_path / "in", "a.xlsx", {"s": [["protocol_id"], *[[str(i)] for i in range(20)]]})
    log = readers.scan_export(spark, str(tmp_path / "in"))
    assert "MapInArrow" not in log._jdf.queryExecution().toString()
    assert rows(log, "seq", "protocol_id") == sorted(
        ((i, str(i)) for i in range(20)), key=lambda r: tuple(map(str, r))
    )
