"""Every operator on a log without rows."""

import datetime as dt

import pytest

from worklens.operators import cleaning, filters, idle, individual, overview, rankings, reports
from worklens.plans.cube import activity_cube

FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 31)

# operators with a row of totals whatever the log
ONE_ROW = {"overview_kpis", "team_tmo"}

PLAIN = [
    cleaning.clean_batch, cleaning.duration_adjustments, cleaning.standardise_task_log,
    filters.default_roster, filters.filter_analysts, filters.drop_doubt_outliers,
    overview.overview_kpis, overview.queue_summary, overview.production_by_group,
    overview.outcome_by_module, overview.email_group_detail, overview.daily_productivity,
    overview.daily_registered_updated, overview.daily_tmo, overview.daily_tmo_closed,
    overview.daily_tmo_closed_zero_filled, overview.daily_tmo_registered,
    overview.monthly_tmo_by_outcome, overview.monthly_tmo, overview.analyst_tmo,
    overview.deviation_counts, overview.deviation_counts_real, overview.top_deviation,
    rankings.rank_overall, rankings.all_rankings, rankings.best_by_queue_tmo,
    rankings.best_by_queue_volume, rankings.most_productive, individual.analyst_metrics,
    individual.team_tmo, individual.analyst_vs_team, individual.best_day_tmo,
    individual.best_day_volume, individual.analyst_queue_tmo, individual.queue_tmo_finished,
    individual.analyst_monthly_tmo, individual.daily_task_count, individual.queue_counts,
    individual.cause_counts, individual.portfolio_status_counts, individual.portfolio_tmo,
    individual.points_of_attention, idle.idle_time_daily, idle.idle_time_mean,
    idle.idle_time_total, activity_cube,
]
OVER_A_PERIOD = [
    reports.period_summary, reports.cause_by_analyst, reports.period_registered_updated,
    reports.analyst_daily_detail, reports.period_full_summary, reports.registration_report,
    reports.analyst_scorecard,
]


@pytest.mark.parametrize("operator", PLAIN, ids=lambda f: f.__name__)
def test_plain(make_log, operator):
    assert operator(make_log()).count() == (1 if operator.__name__ in ONE_ROW else 0)


@pytest.mark.parametrize("operator", OVER_A_PERIOD, ids=lambda f: f.__name__)
def test_over_a_period(make_log, operator):
    assert operator(make_log(), FIRST, LAST).count() == 0


def test_others(make_log):
    log = make_log()
    assert filters.filter_last_days(log, 30).count() == 0
    assert reports.period_comparison(log, (FIRST, LAST), (FIRST, LAST)).count() == 0
    assert reports.data_question_aggregates(log).count() <= 1
    card = {r["item"]: r["value"] for r in reports.team_card(log, FIRST, LAST).collect()}
    assert set(card.values()) == {None} and "top_registrant" not in card
