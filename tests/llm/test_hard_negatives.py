"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest

from worklens.llm import hard_negatives
from worklens.llm.hard_negatives import spanning_tree

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string, tree int"


def plain(rows, anchors, positives=5, negatives=10):
    usable = []
    for vec_id, vector, label in rows:
        if label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        usable.append((vec_id, [max(-(2**40), min(2**40, x)) for x in whole], label))
    def order(scored):
        return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))

    out = []
    for i, (anchor, a, label) in enumerate(usable):
        if anchor is None or anchor % anchors:
            continue
        scored = [
            (sum(x * y for x, y in zip(a, v)), vec_id, lab)
            for j, (vec_id, v, lab) in enumerate(usable) if j != i
        ]
        for ps, pid, _ in order(s for s in scored if s[2] == label)[:positives]:
            inside = [s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps]
            for rank, (ns, nid, _) in enumerate(order(inside)[:negatives], 1):
                out.append((anchor, pid, rank, nid, ps, ns))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def found(df):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def clustered(n, dim=8, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    label = rng.integers(0, labels, n)
    # Rounded, so that scores tie.
    rows = np.round(centres[label] * 0.4 + rng.normal(size=(n, dim)) * 0.4, 1)
    return [(i, [float(x) for x in row], int(c)) for i, (row, c) in enumerate(zip(rows, label))]


def test_all_pairs(spark, monkeypatch):
    for name, value in (("BLOCK", 37), ("BLOCKS", 2), ("TREE", 7), ("TREES", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(500)
    got = found(hard_negatives.hard_negatives(table(spark, rows).repartition(5), "vec_id % 10 = 0"))
    assert got == plain(rows, 10) and len(got) > 500


def test_odd_rows(spark):
    rows = clustered(60) + [
        (0, [0.5] * 8, 1), (10, [0.1] * 8, 0), (10, [0.1] * 8, 0), (None, [0.3] * 8, 1),
        (None, [0.3] * 8, 2), (100, None, 1), (110, [0.2] * 8, None), (120, [None] + [0.1] * 7, 1),
        (130, [float("nan")] * 8, 1), (140, [float("inf")] * 8, 1), (150, [], 1), (160, [0.4] * 3, 2),
        (170, [0.4] * 12, 2), (180, [0.0] * 8, 1), (61, [0.0] * 8, 1),
    ]
    got = found(hard_negatives.hard_negatives(table(spark, rows), "vec_id % 10 = 0"))
    assert got == plain(rows, 10)
    assert found(hard_negatives.hard_negatives(table(spark, []), "vec_id % 10 = 0")) == []
    assert found(hard_negatives.hard_negatives(table(spark, rows), "false")) == []


def test_great_components(spark):
    random.seed(5)
    rows = [(i, [random.uniform(-3e6, 3e6) for _ in range(6)], i % 3) for i in range(80)]
    got = found(hard_negatives.hard_negatives(table(spark, rows), "vec_id % 10 = 0"))
    assert got == plain(rows, 10) and got


def test_tree_is_shortest():
    rows = np.random.default_rng(2).integers(-50, 50, (40, 5))
    order, parent, edge = spanning_tree(rows)
    gaps = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    seen, total = {int(order[0])}, 0.0
    while len(seen) < 40:
        inside = sorted(seen)
        outside = [i for i in range(40) if i not in seen]
        sub = gaps[np.ix_(inside, outside)]
        total += sub.min()
        seen.add(outside[int(sub.min(0).argmin())])
    assert sorted(order) == list(range(40)) and edge.sum() == pytest.approx(total)
    place = {int(n): i for i, n in enumerate(order)}
    assert all(place[int(parent[n])] < place[int(n)] for n in order[1:])


def test_bounds_spare_most_scores():
    rng = np.random.default_rng(3)
    near = rng.integers(-100, 100, (1, 16)) + rng.integers(-2, 3, (50, 16))
    order, parent, edge = spanning_tree(near)
    others = rng.integers(-100, 100, (2000, 16)).astype(float)
    scores = near.astype(float) @ others.T
    reach = edge[:, None] * np.sqrt((others**2).sum(1))[None]
    assert (np.abs(scores - scores[parent]) <= reach + 1e-6).all()
