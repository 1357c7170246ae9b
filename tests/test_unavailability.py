import datetime as dt

from conftest import rows

from worklens.operators import unavailability

DAY = dt.date(2024, 1, 10)


def at(hour, minute=0, day=10):
    return dt.datetime(2024, 1, day, hour, minute)


def intervals(spark, *pairs):
    return spark.createDataFrame(list(pairs), "start_at timestamp_ntz, end_at timestamp_ntz")


def test_clipped_to_working_hours(spark):
    df = intervals(spark, (at(7), at(9)), (at(17, 30), at(20)), (at(19), at(20)), (at(6), at(7)),
                   (at(10), None))
    assert rows(unavailability.unavailability_daily(df), "day", "minutes") == [
        (DAY, 0), (DAY, 0), (DAY, 30), (DAY, 60),
    ]


def test_share_counts_overlaps_twice_and_stays_positive(spark):
    df = intervals(spark, (at(8), at(18)), (at(9), at(10, 30)), (at(9, day=11), at(10, day=11)))
    share = unavailability.unavailability_share(df, DAY, DAY).first()
    assert tuple(share) == (11 * 3600 + 1800, 0, "11h 30m", "0h 0m")
    share = unavailability.unavailability_share(df, dt.date(2024, 1, 11), dt.date(2024, 1, 12))
    assert tuple(share.first()) == (3600, 19 * 3600, "1h 0m", "19h 0m")
    nothing = unavailability.unavailability_share(df, dt.date(2025, 1, 1), dt.date(2025, 1, 1))
    assert nothing.first().worked_s == 36_000
