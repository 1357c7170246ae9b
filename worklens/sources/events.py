"""A task log and unavailability intervals derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE,"
    " props STRING"
)

# The words of the derived log, by the number that picks them.
STATUSES = ["Cancelled", "Open", *["Finished"] * 18]
QUEUES = [
    "REG EMAIL", "OFFICIAL LETTERS", "AGENCIES", "PRE REG", "PRE REG B", "REG FINES", "AUDIT",
    "DIST", "DIST A", "DOUBT", "Unknown", "REG SHARED", "REG SUMMONS", "INCIDENT",
    "Distribution", None,
]
TASK_TYPES = ["NEW CASE", "NEW DOC", "REVIEW"]
MODULES = ["CIVIL", "LABOUR", "TAX", "FINES", None]
DEVIATIONS = [
    "No deviation", "date", "date, party", "party,value , court", "value,,date", None, None, None,
]
PORTFOLIO_STATUSES = ["CLOSED", "RECLASSIFIED", "IN_PROGRESS", "OTHER"]
OTHER_OUTCOMES = [None, "BATCH_CLOSED", "WITHDRAWN", "REGISTERED"]
ANALYSTS = [*[f"analyst_{i:02d}" for i in range(12)], "Robot_Hub", "analyst_13_ter",
            "analyst_14_ter"]
CAUSES = [None, *[f"CAUSE {i}" for i in range(1, 7)]]
PORTFOLIOS = [None, "FAST", *[f"PORTFOLIO {i}" for i in range(2, 5)]]


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table by its declared schema, so no file is opened to find it."""
    return spark.read.schema(EVENTS).parquet(path)


def _pick(words: list[str | None], number: str) -> str:
    """The word at ``number`` modulo their count: one lookup, however many words."""
    listed = ", ".join("NULL" if w is None else f"'{w}'" for w in words)
    return f"get(array({listed}), CAST({number} % {len(words)} AS INT))"


def task_log_from_events(events: DataFrame) -> DataFrame:
    timed = events.selectExpr(
        "*",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k",
        "ts + make_dt_interval(2 * (day(ts) - 1)) AS done_at",
        "CAST(round(value * 60) AS BIGINT) AS secs",
    )
    return timed.selectExpr(
        "event_id AS seq",
        "CASE WHEN event_id % 50 <> 7 THEN event_id - IF(event_id % 10 = 9, 1, 0) END"
        " AS protocol_id",
        f"IF(user_id = 0, NULL, {_pick(ANALYSTS, 'user_id')}) AS analyst",
        f"{_pick(STATUSES, 'event_id')} AS status",
        "CASE event_type WHEN 'signup' THEN 'REGISTERED' WHEN 'purchase' THEN 'UPDATED'"
        " WHEN 'view' THEN 'DISTRIBUTED' WHEN 'click' THEN 'AUDITED'"
        f" ELSE {_pick(OTHER_OUTCOMES, 'event_id')} END AS outcome",
        f"{_pick(QUEUES, 'k')} AS queue",
        f"{_pick(TASK_TYPES, 'event_id')} AS task_type",
        f"{_pick(MODULES, 'event_id')} AS module",
        f"{_pick(CAUSES, 'k')} AS cause",
        f"{_pick(DEVIATIONS, 'k')} AS deviations",
        "IF(event_id % 50 = 0, NULL, secs * 1000000) AS duration_us",
        "done_at AS completed_at",
        f"{_pick(PORTFOLIOS, 'k')} AS portfolio",
        f"{_pick(PORTFOLIO_STATUSES, 'event_id')} AS portfolio_status",
        "CAST(round(value * 6) AS BIGINT) * 1000000 AS analysis_us",
        "IF(event_id % 97 = 0, NULL, done_at - make_dt_interval(0, 0, 0, secs)) AS started_at",
    )


def unavailability_from_events(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'error'").selectExpr(
        "ts AS start_at",
        "ts + make_dt_interval(0, 0, 0, CAST(round(value * 60) AS BIGINT)) AS end_at",
    )
