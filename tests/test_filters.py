import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from worklens.operators import filters


def at(day, hour=12):
    return {"completed_at": dt.datetime(2024, 1, day, hour)}


def test_period_is_inclusive_and_drops_missing(make_log):
    log = make_log(at(9, 23), at(10, 0), at(12, 23), at(13, 0), {"completed_at": None})
    got = filters.filter_period(log, dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    assert rows(got, "seq") == [(1,), (2,)]
    stored = log.withColumn("completed_date", F.to_date("completed_at"))
    again = filters.filter_period(stored, dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    assert rows(again, "seq") == [(1,), (2,)]


def test_last_days(make_log):
    log = make_log(at(1), at(5), at(6), at(8))
    assert rows(filters.filter_last_days(log, 3), "seq") == [(1,), (2,), (3,)]
    daily = log.select("analyst", F.to_date("completed_at").alias("day"))
    other = daily.filter("day = '2024-01-01'").withColumn("analyst", F.lit("bob"))
    got = filters.filter_last_days(daily.union(other), 2, ["analyst"])
    assert rows(got) == [
        ("ana", dt.date(2024, 1, 6)), ("ana", dt.date(2024, 1, 8)), ("bob", dt.date(2024, 1, 1)),
    ]
    assert filters.filter_last_days(daily.union(other), 2, ()).count() == 2


def test_roster(make_log, spark):
    log = make_log(*[{"analyst": a} for a in ("ana", "bob", "eve_ter", "sup", None, "ana")])
    assert rows(filters.default_roster(log, ["sup"])) == [("ana",), ("bob",)]
    assert filters.filter_analysts(log).count() == 5
    assert filters.filter_analysts(log, ["bob", "zoe"]).count() == 1
    assert filters.filter_analysts(log, filters.is_rostered(["sup"])).count() == 3
    table = spark.createDataFrame([("ana",), ("ana",)], "analyst string")
    assert filters.filter_analysts(log, table).count() == 2


def test_doubt_outliers_keep_missing(make_log):
    log = make_log(
        {"queue": "DOUBT", "minutes": 60}, {"queue": "DOUBT", "minutes": 61},
        {"queue": "DOUBT", "minutes": None}, {"queue": None, "minutes": 90},
        {"queue": "AUDIT", "minutes": 90},
    )
    assert rows(filters.drop_doubt_outliers(log), "seq") == [(0,), (2,), (3,), (4,)]


def test_months(make_log):
    log = make_log(at(1), {"completed_at": dt.datetime(2024, 2, 1)}, {"completed_at": None})
    assert filters.filter_months(log).count() == 3
    assert rows(filters.filter_months(log, ["2024-02"]), "seq") == [(1,)]
    table = log.select(F.lit("2024-02").alias("month"))
    assert filters.filter_months(table, ["2024-01"]).count() == 0
