"""The first task of each protocol over batches that are replaced, merged and cut to periods."""

import datetime as dt
import random

import pytest
from conftest import rows

from worklens.operators import overview
from worklens.operators.filters import filter_period
from worklens.plans import cube
from worklens.plans.first_tasks import scan_first_tasks
from worklens.sources import readers, store, writers


def some(make_log, seed, n=60):
    random.seed(seed)
    return make_log(
        *[
            {
                "protocol_id": random.choice(["1", "2", "3", "4", None]),
                "queue": random.choice(["Q", "AUDIT", "DIST", None]),
                "outcome": random.choice(["REGISTERED", "UPDATED", "AUDITED", "DISTRIBUTED", None]),
                "minutes": random.choice([5, 40, None]),
                "completed_at": random.choice([dt.datetime(2024, 1, d) for d in (1, 2, 3)] + [None]),
            }
            for _ in range(n)
        ]
    )


@pytest.mark.parametrize("seed", range(3))
def test_as_from_the_log(spark, tmp_path, make_log, seed):
    root = str(tmp_path / "log")
    for step, batch in enumerate((2, 0, 1, 0, 2)):
        made = some(make_log, 10 * seed + step)
        writers.write_task_log(made, batch, root, with_cube=True, with_firsts=step != 1)
        if step == 2:
            writers.compact_log(spark, root)
    found = store.snapshot(spark, root)
    log = readers.scan_task_log(spark, root)
    first, last = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    for part, whole in ((found, log), (found.between(first, last), filter_period(log, first, last))):
        summed = cube.scan_stored_cube(spark, part)
        got = overview.queue_summary(summed, firsts=scan_first_tasks(spark, part))
        assert rows(got) == rows(overview.queue_summary(whole)) and got.count()


def test_the_log_is_not_read(spark, tmp_path, make_log):
    root = str(tmp_path / "log")
    writers.write_task_log(some(make_log, 1), 0, root, with_cube=True, with_firsts=True)
    found = store.snapshot(spark, root)
    summary = overview.queue_summary(
        cube.scan_stored_cube(spark, found), firsts=scan_first_tasks(spark, found)
    )
    assert {f.split("/segment=")[0].rsplit("/", 1)[1] for f in summary.inputFiles()} == {
        "cube", "firsts",
    }
