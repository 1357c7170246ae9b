"""Sums over many periods against one scan a period; covered time against a count of seconds."""

import datetime as dt
import random

from conftest import rows

from worklens.functions.measures import mean_s, tasks, with_measures
from worklens.functions.sql import equals, exprs
from worklens.operators import unavailability
from worklens.operators.filters import filter_period
from worklens.plans import cube, periods

BEGIN = dt.date(2024, 1, 1)


def made(make_log, seed, n=150):
    random.seed(seed)
    return make_log(
        *[
            {
                "analyst": random.choice(["ana", "bob", "eve", None]),
                "outcome": random.choice(["REGISTERED", "UPDATED", "AUDITED", None]),
                "minutes": random.choice([1, 7.5, 30, None]),
                "completed_at": random.choice(
                    [dt.datetime(2024, 1, 1, 12) + dt.timedelta(random.choice([0, 1, 5, 40, 41, 200])), None]
                ),
            }
            for _ in range(n)
        ]
    )


def one_scan(log, first, last):
    kinds = {k: equals("outcome", k.upper()) for k in ("registered", "updated")}
    figures = {}
    for name, kind in kinds.items():
        figures |= {f"{name}_tmo_s": mean_s(kind), name: tasks(kind)}
    handled = with_measures(filter_period(log, first, last)).filter(" OR ".join(kinds.values()))
    return rows(handled.filter("analyst IS NOT NULL").groupBy("analyst").agg(*exprs(figures)))


def test_each_period_is_that_of_a_scan(spark, make_log):
    for seed in range(2):
        log = made(make_log, seed)
        asked = [
            (i, BEGIN + dt.timedelta(random.randint(-5, 210)), BEGIN + dt.timedelta(random.randint(-5, 210)))
            for i in range(25)
        ]
        table = spark.createDataFrame(asked, "id int, first_day date, last_day date")
        for source in (log, cube.activity_cube(log)):
            got = periods.many_periods(source, table).drop("first_day", "last_day")
            want = []
            for i, first, last in asked:
                want += [(i, *r) for r in one_scan(log, first, last)]
            assert rows(got) == sorted(want, key=lambda r: tuple(map(str, r)))


def test_open_equal_and_empty_periods(spark, make_log):
    log = make_log(*[{"completed_at": dt.datetime(2024, 1, d)} for d in (1, 2, 9)])
    days = [dt.date(2024, 1, d) for d in (1, 2, 9)]
    asked = [(None, None), (None, days[1]), (days[1], None), (days[1], days[0]), (days[0], days[0]),
             (days[0], days[0]), (dt.date(2030, 1, 1), None), (None, dt.date(1990, 1, 1))]
    table = spark.createDataFrame(asked, "first_day date, last_day date")
    got = periods.many_periods(log, table)
    assert sorted(((r.first_day, r.last_day, r.registered) for r in got.collect()), key=str) == sorted(
        [(None, None, 3), (None, days[1], 2), (days[1], None, 2), *[(days[0], days[0], 1)] * 2], key=str
    )
    assert periods.many_periods(log.limit(0), table).count() == 0
    assert periods.many_periods(log, table.limit(0)).count() == 0


def test_one_scan_of_the_log(spark, make_log, tmp_path):
    made(make_log, 3).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    table = spark.createDataFrame([(BEGIN, BEGIN)], "first_day date, last_day date")
    plan = periods.many_periods(log, table)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "CartesianProduct" not in text


def test_covered_seconds(spark):
    random.seed(8)
    some = []
    for _ in range(60):
        start = dt.datetime(2024, 1, 1, 6) + dt.timedelta(minutes=15 * random.randint(0, 250))
        some.append((start, start + dt.timedelta(minutes=random.choice([-30, 0, 15, 60, 700, 3000]))))
    some += [(None, some[0][1]), (some[0][0], None), some[0]]
    got = unavailability.unavailability_covered(
        spark.createDataFrame(some, "start_at timestamp_ntz, end_at timestamp_ntz")
    )
    covered = {}
    for start, end in some:
        if start is None or end is None:
            continue
        at = start
        while at < end:
            if 8 <= at.hour < 18:
                covered.setdefault(at.date(), set()).add(at)
            at += dt.timedelta(minutes=15)
    have = {r.day: r.covered_s for r in got.collect() if r.covered_s}
    assert have == {d: 900 * len(slots) for d, slots in covered.items()}
    present = unavailability.unavailability_daily(
        spark.createDataFrame(some, "start_at timestamp_ntz, end_at timestamp_ntz")
    )
    assert sum(r.unavailable_s for r in got.collect()) == sum(60 * r.minutes for r in present.collect())
