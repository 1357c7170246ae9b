import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from worklens.functions.calendar import interval_us, parse_interval_time, parse_task_time
from worklens.functions.durations import (
    h_mm_ss,
    hms,
    hours_min_sec,
    m_ss,
    min_sec,
    parse_duration,
)
from worklens.functions.text import protocol_text, strip


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").selectExpr(column("v")).first()[0]


def expected(text):
    value = pd.to_timedelta(text, errors="coerce")
    return None if pd.isna(value) else value.value // 1000


TEXTS = [
    "00:12:30", "1 days 02:03:04", "-2 days 02:03:04", "12 days 00:00:00", "x days 00:00:01",
    "99:00:00",
    "0 days 00:12:30.5", "12:30", "2 days", "1 day, 0:00:05",
    "-1 days +23:00:00", "abc", "", "1:2:3", "00:99:99", " 00:01:00 ", "26:00:00",
    "1 days 26:00:00", "-00:01:00", "+00:01:00", "00:00:01.123456", "not a time",
]


def test_parse_matches_pandas(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    got = {r.v: r.us for r in df.selectExpr("v", f"{parse_duration('v')} AS us").collect()}
    assert got == {t: expected(t) for t in TEXTS}


def test_parse_null(spark):
    assert one(spark, parse_duration, None) is None


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 23), st.integers(0, 59),
                          st.integers(0, 59), st.booleans()), min_size=20, max_size=40))
def test_parse_matches_pandas_on_generated(spark, parts):
    texts = [
        f"{d} days {h:02d}:{m:02d}:{s:02d}" if long else f"{h:02d}:{m:02d}:{s:02d}"
        for d, h, m, s, long in parts
    ]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.selectExpr(parse_duration("v")).collect()]
    assert got == [expected(t) for t in texts]


@pytest.mark.parametrize(
    "shape, value, shown",
    [
        (hms, 0, "00:00:00"), (hms, 3661, "01:01:01"), (hms, 360_000, "100:00:00"),
        (hms, None, "00:00:00"),
        (min_sec, 61, "1 min 1s"), (min_sec, 7322, "122 min 2s"), (min_sec, None, "0 min"),
        (m_ss, 125, "2:05"), (m_ss, None, None),
        (h_mm_ss, 3661, "1:01:01"), (h_mm_ss, 90_000, "1 day, 1:00:00"),
        (h_mm_ss, 180_000, "2 days, 2:00:00"), (h_mm_ss, None, "00:00:00"),
        (hours_min_sec, 59 * 60_000_000 + 400_000, "59 min 0s"),
        (hours_min_sec, 61 * 60_000_000 + 1_600_000, "1h 1m 2s"), (hours_min_sec, None, None),
    ],
)
def test_shown_forms(spark, shape, value, shown):
    assert one(spark, shape, value, "bigint") == shown


def test_text_helpers(spark):
    assert one(spark, strip, "  a b\t\n") == "a b"
    assert one(spark, protocol_text, "1,234,567.0") == "1234567"
    assert one(spark, protocol_text, "10.05") == "10.05"


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    # midnight of 2018-11-04 does not exist in Sao Paulo
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(
            [("04/11/2018 00:30:00",), ("31/02/2024 10:00:00",), ("2024-01-05 10:00:00",),
             ("4/1/2018 0:3:00",), ("04/11/2018T00:30:00",), ("04/11/2018 00:30:0Z",)],
            "v string",
        )
        got = df.selectExpr(f"CAST({parse_task_time('v')} AS STRING) AS t").collect()
        assert [r.t for r in got] == ["2018-11-04 00:30:00", None, None, "2018-01-04 00:03:00", None, None]
        late = f"({parse_task_time('v')} - TIMESTAMP_NTZ '2018-11-03 23:30:00.25')"
        gap = df.limit(1).selectExpr(f"{interval_us(late)} AS us")
        assert gap.first().us == 3_600_000_000 - 250_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_interval_time(spark):
    df = spark.createDataFrame([(" 2024-01-05 08:00",), ("2024-13-05 08:00",), ("x",)], "v string")
    got = df.selectExpr(f"CAST({parse_interval_time('v')} AS STRING) AS t").collect()
    assert [r.t for r in got] == ["2024-01-05 08:00:00", None, None]
