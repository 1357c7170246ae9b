import datetime as dt

import pytest
from conftest import rows

from checks.queries import clean_log
from worklens.operators import idle, individual, overview, rankings
from worklens.operators.filters import filter_last_days, filter_period, is_rostered
from worklens.plans.cube import activity_cube, add_to_cube, scan_cube
from worklens.plans.pages import individual_page, overview_page

FIRST, LAST = dt.date(2024, 1, 5), dt.date(2024, 3, 20)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return clean_log(spark, DATA).cache()


CUBE_OPERATORS = [
    overview.overview_kpis, overview.production_by_group, overview.daily_productivity,
    overview.daily_registered_updated, overview.daily_tmo, overview.daily_tmo_closed,
    overview.daily_tmo_closed_zero_filled, overview.daily_tmo_registered,
    overview.monthly_tmo_by_outcome, overview.monthly_tmo, overview.analyst_tmo,
    rankings.rank_overall, rankings.all_rankings, rankings.rank_updates,
    rankings.best_by_queue_tmo, rankings.best_by_queue_volume, rankings.most_productive,
    individual.analyst_metrics, individual.team_tmo, individual.analyst_vs_team,
    individual.best_day_tmo, individual.best_day_volume, individual.analyst_queue_tmo,
    individual.queue_tmo_finished, individual.analyst_monthly_tmo, individual.daily_task_count,
    individual.queue_counts,
]


@pytest.mark.parametrize("operator", CUBE_OPERATORS, ids=lambda f: f.__name__)
def test_cube_gives_the_same_as_the_log(log, operator):
    assert rows(operator(activity_cube(log))) == rows(operator(log))


def test_overview_page(log):
    page = overview_page(log, FIRST, LAST, ["analyst_03"])
    span = filter_period(log, FIRST, LAST)
    roster = is_rostered(["analyst_03"])
    assert rows(page["kpis"]) == rows(overview.overview_kpis(span))
    assert rows(page["rank_overall"]) == rows(rankings.rank_overall(span, roster))
    assert rows(page["queues"]) == rows(overview.queue_summary(span))
    for name in page:
        assert page[name].count() > 0, name
    page.unpersist()


def test_stored_cube_adds_up_over_batches(spark, log, tmp_path):
    path = str(tmp_path / "cube")
    assert scan_cube(spark, path).count() == 0
    halves = [log.filter("seq % 3 = 0"), log.filter("seq % 3 <> 0")]
    for batch_no, batch in enumerate(halves):
        for _ in range(2):  # the second write replaces the first
            add_to_cube(batch, batch_no, path)
    cube = scan_cube(spark, path)
    for operator in (overview.overview_kpis, rankings.all_rankings, individual.analyst_metrics,
                     individual.analyst_queue_tmo, overview.monthly_tmo_by_outcome):
        assert rows(operator(cube)) == rows(operator(log))
    page = overview_page(log, FIRST, LAST, stored_cube=cube)
    span = filter_period(log, FIRST, LAST)
    assert rows(page["kpis"]) == rows(overview.overview_kpis(span))


def test_individual_page(log):
    page = individual_page(log, FIRST, LAST)
    span = filter_period(log, FIRST, LAST)
    assert rows(page["metrics"]) == rows(individual.analyst_metrics(span))
    assert rows(page["idle_daily_recent"]) == rows(
        filter_last_days(idle.idle_time_daily(span), 30, ["analyst"])
    )
    for name in page:
        assert page[name].count() > 0, name
    page.unpersist()
