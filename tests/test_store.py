"""The versioned log: killed writes, snapshots, compaction, repeated uploads, latest days."""

import datetime as dt
import random

import pytest
from conftest import MINUTE, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.functions.sql import order_of
from worklens.operators import overview
from worklens.plans import cube
from worklens.sources import files, readers, repeats, store, writers

DAYS = [dt.datetime(2024, 1, d, 9) for d in range(1, 8)]


def state(spark, root):
    """Everything a reader sees: the log, the cube, the adjustments."""
    found = store.snapshot(spark, root)
    return (
        rows(store.scan_log(spark, found), "batch", "seq", "completed_date", "duration_us"),
        rows(overview.overview_kpis(cube.scan_stored_cube(spark, found))),
        rows(readers.scan_adjustments(spark, root)),
    )


def on(make_log, *days, **columns):
    return make_log(*[{"completed_at": DAYS[d] if d is not None else None, **columns} for d in days])


STEPS = [
    (store, "stage_log"), (store, "stage_beside"), (repeats, "stage_words"), (store, "switch"),
    (store, "write_new"),
]


@pytest.mark.parametrize("module, step", STEPS, ids=lambda v: getattr(v, "__name__", v))
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_write_leaves_the_old_version(spark, tmp_path, make_log, monkeypatch, module, step, when):
    root = str(tmp_path / "log")
    writers.write_task_log(on(make_log, 0, 1, 2, minutes=5), 0, root, with_cube=True, new_rows_only=True)
    writers.write_task_log(on(make_log, 1, None, minutes=300), 1, root, with_cube=True, new_rows_only=True)
    old = state(spark, root)
    real = getattr(module, step)

    def dies(*args, **options):
        if when == "after":
            real(*args, **options)
        raise KeyboardInterrupt

    new = on(make_log, 3, minutes=40)
    with monkeypatch.context() as patch:
        patch.setattr(module, step, dies)
        with pytest.raises(KeyboardInterrupt):
            writers.write_task_log(new, 0, root, with_cube=True, new_rows_only=True)
    switched = when == "after" and step in ("switch", "write_new")
    assert (state(spark, root) == old) != switched
    writers.write_task_log(new, 0, root, with_cube=True, new_rows_only=True)
    assert [r[:3] for r in state(spark, root)[0]] == [
        (0, 0, DAYS[3].date()), (1, 0, DAYS[1].date()), (1, 1, None),
    ]


def test_a_second_writer_does_not_switch(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    writers.write_task_log(on(make_log, 0), 0, root)
    found = store.snapshot(spark, root)
    store.switch(spark, found)
    with pytest.raises(FileExistsError):
        store.switch(spark, found)
    assert not [n for n in files.names_in(spark, f"{root}/_versions") if n.startswith(".0")]


def test_snapshots_stay_readable(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    versions = []
    for batch, days in ((0, [0, 1]), (1, [1, 2]), (0, [5]), (1, [])):
        writers.write_task_log(on(make_log, *days), batch, root, with_cube=True)
        versions.append(store.snapshot(spark, root))
    writers.compact_log(spark, root)
    counts = [store.scan_log(spark, v).count() for v in versions]
    assert counts == [2, 4, 3, 1]
    assert [cube.scan_stored_cube(spark, v).agg(F.sum("n")).first()[0] for v in versions] == counts
    store.expire(spark, root, keep=1)
    assert store.scan_log(spark, store.snapshot(spark, root)).count() == 1
    assert len(files.names_in(spark, f"{root}/_versions")) == 1
    found = store.snapshot(spark, root)
    live = {e.segment for e in found.entries} | set(found.adjustments.values())
    assert {n.removeprefix("segment=") for n in files.names_in(spark, f"{root}/log")} <= live


@pytest.mark.parametrize("seed", range(3))
def test_compaction_changes_no_row(spark, tmp_path, make_log, seed):
    """Batches written, replaced and compacted in any order give what was written last."""
    random.seed(seed)
    root, last = str(tmp_path / "log"), {}
    for _ in range(9):
        if random.random() < 0.3:
            before = state(spark, root)
            writers.compact_log(spark, root)
            assert state(spark, root) == before
            found = store.snapshot(spark, root).entries
            assert len({e.day for e in found}) == len(found) and not any(e.hidden for e in found)
        batch = random.randint(0, 3)
        last[batch] = [random.choice([None, *range(7)]) for _ in range(random.randint(0, 4))]
        made = on(make_log, *last[batch], minutes=random.choice([5, 30, None]))
        writers.write_task_log(made, batch, root, with_cube=random.random() < 0.8)
    want = [
        (b, i, DAYS[d].date() if d is not None else None)
        for b, days in last.items() for i, d in enumerate(days)
    ]
    log, kpis, _ = state(spark, root)
    assert sorted((r[:3] for r in log), key=str) == sorted(want, key=str)
    assert kpis == rows(overview.overview_kpis(cube.activity_cube(readers.scan_task_log(spark, root))))


def test_further_columns_outlive_compaction(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    for batch, sql in enumerate(("'a' AS note", "1 AS n", "'b' AS n", "2.5D AS size")):
        writers.write_task_log(on(make_log, 0).selectExpr("*", sql), batch, root)
    writers.compact_log(spark, root)
    kinds = {"x_note": T.StringType(), "x_n": T.StringType(), "x_size": T.DoubleType()}
    extra = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    assert rows(readers.scan_task_log(spark, root, extra), "batch", *kinds) == [
        (0, "a", None, None), (1, None, "1", None), (2, None, "b", None), (3, None, None, 2.5),
    ]
    writers.compact_log(spark, root)
    assert readers.scan_task_log(spark, root, extra).count() == 4


def test_a_period_lists_its_own_days(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    for batch in range(12):
        writers.write_task_log(on(make_log, batch % 7, (batch + 1) % 7), batch, root)
    whole = rows(readers.scan_task_log(spark, root), "batch", "seq")
    writers.compact_log(spark, root)
    log = readers.scan_task_log(spark, root)
    assert rows(log, "batch", "seq") == whole
    place = log.selectExpr(f"{order_of(log.columns)} AS place", "batch", "seq").orderBy("place")
    assert [tuple(r[1:]) for r in place.collect()] == sorted(whole)
    first, last = DAYS[2].date(), DAYS[3].date()
    some = readers.scan_task_log(spark, root, first=first, last=last)
    assert len(some.inputFiles()) == 2 and some.count() == log.filter(
        F.col("completed_date").between(first, last)
    ).count()
    # A day in which nothing was added is not written again.
    before = {e.day: e.segment for e in store.snapshot(spark, root).entries}
    writers.write_task_log(on(make_log, 0), 50, root)
    writers.compact_log(spark, root)
    after = {e.day: e.segment for e in store.snapshot(spark, root).entries}
    assert {d for d in after if after[d] != before[d]} == {DAYS[0].date().isoformat()}


def test_latest_days_are_the_only_ones_read(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    writers.write_task_log(on(make_log, 0, 3, 5, None), 0, root)
    writers.write_task_log(on(make_log, 6, 4), 1, root)
    found = readers.scan_last_days(spark, root, 2)
    assert rows(found, "completed_date") == [(DAYS[d].date(),) for d in (4, 5, 6)]
    assert len(found.inputFiles()) == 3
    assert readers.scan_last_days(spark, str(tmp_path / "none"), 2).count() == 0


def plain_new(stored, upload):
    held = set(stored)
    return [r for r in upload if r not in held]


@pytest.mark.parametrize("compacted", [False, True])
def test_repeated_rows_are_left_out(spark, tmp_path, make_log, compacted):
    random.seed(7)
    root = str(tmp_path / "log")
    columns = ("protocol_id", "analyst", "queue", "duration_us", "completed_at", "justification")

    def some(n):
        return [
            {
                "protocol_id": random.choice(["1", "2", None]), "analyst": random.choice(["a", "b"]),
                "queue": random.choice(["q", None]), "completed_at": random.choice([*DAYS[:3], None]),
                "minutes": random.choice([5, 50, None]), "justification": random.choice(["", None]),
            }
            for _ in range(n)
        ]

    def known(log):
        return [tuple(r) for r in log.fillna("", "justification").select(*columns).collect()]

    stored = []
    for batch in range(4):
        upload = make_log(*some(25))
        want = plain_new(stored, known(upload))
        writers.write_task_log(upload, batch, root, new_rows_only=True)
        if compacted:
            writers.compact_log(spark, root)
        mine = readers.scan_task_log(spark, root).filter(f"batch = {batch}")
        mine = mine.drop("duration_us").withColumnRenamed("duration_before_us", "duration_us")
        assert sorted(known(mine), key=str) == sorted(want, key=str)
        stored += want
    assert len(stored) < 100
    writers.write_task_log(make_log(*some(5)), 9, root)  # without a filter: always read
    assert any(not e.words for e in store.snapshot(spark, root).entries)
    writers.write_task_log(upload, 10, root, new_rows_only=True)
    assert readers.scan_task_log(spark, root).filter("batch = 10").count() == 0


def test_new_rows_read_no_stored_text(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    made = make_log(*[{"completed_at": DAYS[i % 7], "protocol_id": str(i)} for i in range(300)])
    writers.write_task_log(made, 0, root, new_rows_only=True)
    found = store.snapshot(spark, root)
    others = make_log(*[{"completed_at": DAYS[0], "protocol_id": f"n{i}"} for i in range(3)])
    other_days = make_log({"completed_at": dt.datetime(2025, 1, 1)})
    assert repeats.may_hold(other_days, found).entries == ()
    fresh = repeats.new_rows(other_days, found)
    assert "segment=" not in fresh._jdf.queryExecution().toString() and fresh.count() == 1
    # A filter of some 16 bits a row is wrong about one row in a hundred or so.
    wrong = sum(
        len(repeats.may_hold(others.filter(f"protocol_id = 'n{i}'"), found).entries) for i in range(3)
    )
    assert wrong <= 1
    held = repeats.may_hold(made.filter("protocol_id = '8'"), found)
    assert [e.day for e in held.entries] == [DAYS[1].date().isoformat()]
