"""Relations between operators that hold for any log."""

import random

import pytest
from conftest import rows

from worklens.operators import individual, overview, rankings


def random_log(make_log, seed):
    rng = random.Random(seed)
    outcomes = ["REGISTERED", "UPDATED", "DISTRIBUTED", "AUDITED", "BATCH_CLOSED", None]
    queues = ["AUDIT", "DIST", "DOUBT", "Unknown", "PRE REG", "REG EMAIL", None]
    return make_log(
        *[
            {
                "analyst": rng.choice([*(f"a{i}" for i in range(rng.choice([3, 15]))), None]),
                "outcome": rng.choice(outcomes),
                "queue": rng.choice(queues),
                "minutes": rng.choice([None, 1, 30, 70, 130]),
            }
            for _ in range(200)
        ]
    )


@pytest.mark.parametrize("seed", range(3))
def test_totals_agree(make_log, seed):
    log = random_log(make_log, seed)
    kpis = overview.overview_kpis(log).first()
    daily = overview.daily_registered_updated(log).first()
    assert (daily.registered, daily.updated) == (kpis.registered, kpis.updated)
    groups = overview.production_by_group(log).collect()
    assert sum(g.registered for g in groups) == kpis.registered
    assert sum(g.registered + g.updated + g.neither for g in groups) == log.count()
    named = log.filter("analyst IS NOT NULL")
    ranked = rankings.rank_overall(log).collect()
    assert sum(r.total for r in ranked) == overview.overview_kpis(named).first().total
    assert sum(r.tasks for r in individual.daily_task_count(log).collect()) == named.count()


@pytest.mark.parametrize("seed", range(3))
def test_positions_and_bands(make_log, seed):
    ranked = rankings.all_rankings(random_log(make_log, seed)).collect()
    for name in {r.ranking for r in ranked}:
        mine = sorted((r for r in ranked if r.ranking == name), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert all(a.total >= b.total and a.band <= b.band for a, b in zip(mine, mine[1:]))
        assert {r.band for r in mine} <= {1, 2, 3, 4}


def test_split_log_adds_up(make_log):
    log = random_log(make_log, 9)
    whole = rows(individual.queue_counts(log))
    parts: dict = {}
    for part in (log.filter("seq < 80"), log.filter("seq >= 80")):
        for analyst, queue, tasks in rows(individual.queue_counts(part)):
            parts[analyst, queue] = parts.get((analyst, queue), 0) + tasks
    assert sorted((a, q, t) for (a, q), t in parts.items()) == whole
