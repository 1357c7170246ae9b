import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from worklens.schema import TASK_LOG  # noqa: E402
from worklens.session import local_session  # noqa: E402

MINUTE = 60_000_000


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "worklens-tests", "4g", tempfile.mkdtemp(prefix="worklens-tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """A task log from partial rows: ``minutes`` sets the duration, ``seq`` counts up."""

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            values = {
                "seq": i,
                "protocol_id": str(1000 + i),
                "analyst": "ana",
                "status": "Finished",
                "outcome": "REGISTERED",
                "queue": "INCIDENT",
                "duration_us": 30 * MINUTE,
                "completed_at": dt.datetime(2024, 1, 10, 12, 0, 0),
                "justification": "",
            }
            row = dict(row)
            if "minutes" in row:
                minutes = row.pop("minutes")
                row["duration_us"] = None if minutes is None else int(minutes * MINUTE)
            values.update(row)
            full.append(tuple(values.get(f.name) for f in TASK_LOG))
        return spark.createDataFrame(full, TASK_LOG)

    return build


def rows(df, *columns):
    """The rows as tuples, in a stable order."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple(map(str, r)))
