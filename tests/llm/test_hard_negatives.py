"""Hard negatives against all pairs, and what the ranges leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import hard_negatives as H

SCHEMA = "id long, label int, vector array<double>, dim int, shard string, block string, square int"


def brute(rows, is_anchor, low=50, high=95, k=5, m=3):
    """rows: {id: (label, integer vector)}"""
    out = []
    for a, (label, v) in rows.items():
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in rows.items()
                  if len(w) == len(v) and i != a]
        for s, i, _ in sorted(x for x in scored if x[2] == label)[:k]:
            good = sorted(x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -high * s)
            out += [(a, i, r, j, -s, -t) for r, (t, j, _) in enumerate(good[:m], 1)]
    return sorted(out)


def whole(vector):
    return [int(np.floor(256 * float(x))) for x in vector]


def valid(rows):
    best = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = whole(v)
        if sum(x * x for x in w) < 2 ** 63 and (i not in best or (label, w) < best[i]):
            best[i] = label, w
    return best


def run(spark, rows, every=3):
    df = spark.createDataFrame([(*r, 1, "s", "b", 1) for r in rows], SCHEMA).repartition(4)
    out = H.mine(H.quantised(df), F.col("id") % every == 0)
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12)) * rng.choice([1, 1, 8], size=(6, 1))
    rows = []
    for i in range(400):
        c = int(rng.integers(6))
        rows.append((i, int(rng.integers(3)), (centres[c] + rng.normal(size=12) * 0.2).tolist()))
    return rows


def test_equals_all_pairs(spark, clustered, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 90)
    monkeypatch.setattr(H, "BLOCK", 30)
    got = run(spark, clustered)
    assert got == brute(valid(clustered), lambda i: i % 3 == 0) and len(got) > 300


def test_unusual_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 2, [0.5, float(i % 5), 0.25]) for i in range(40)]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0, 1.0, 1.0]), (102, 1, None), (105, 0, [1.0, None, 2.0]),
             (108, 0, [1.0, nan, 2.0]), (111, 1, [1.0, -inf, 2.0]), (114, 0, [0.0, 0.0, 0.0]), (117, 1, []),
             (120, 0, []), (123, 1, []), (126, 0, []), (129, 0, [1.0, 2.0]), (130, 0, [1.0, 2.0]), (131, 1, [1.0, 1.2]),
             (3, 1, [0.5, 3.0, 0.25]), (3, 0, [9.0, 9.0, 9.0]), (132, 0, [1e300, 1.0, 1.0]), (135, 1, [1e6, 1e6, 0.5]),
             (136, 0, [9e5, 1e6, 0.5]), (138, 1, [1e6, 1e6, 0.25]), (141, 0, [-1.0, -3.0, 0.5])]
    got = run(spark, rows)
    assert got == brute(valid(rows), lambda i: i % 3 == 0) and got
    assert run(spark, [r for r in rows if r[0] is None]) == []
    assert run(spark, []) == []


def test_hot_label_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 50)
    rows = [(i, 7, [1.0, 0.0, 0.5]) for i in range(300)] + [(i, i % 4, [0.7, 0.1, 0.5]) for i in range(300, 420)]
    assert run(spark, rows, 50) == brute(valid(rows), lambda i: i % 50 == 0)


def test_bounds_of_scores():
    for score in (-7, 0, 1, 2, 19, 20, 10 ** 12 + 7, 2 ** 62):
        low, high = H.within(score, 50, 95)
        assert 100 * low >= 50 * score > 100 * (low - 1) and 100 * high <= 95 * score < 100 * (high + 1)


def test_ranges_leave_rows_out():
    """Few rows are scored where vectors cluster; every good one is found."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) ** 3
    which = rng.integers(40, size=6000)
    vectors = np.floor(256 * (centres[which] + rng.normal(size=(6000, 16)) * 0.05)).astype(np.int64)
    labels = rng.integers(2, size=6000)
    index = H.buckets(np.arange(6000), labels, vectors)
    asked = np.arange(0, 6000, 60)
    goals = [[H.Goal(5)] for _ in asked]
    scored = H.search(index, asked, labels[asked], vectors[asked], goals, True)
    assert scored < 0.5 * len(asked) * 6000
    for a, (goal,) in zip(asked, goals):
        score = vectors @ vectors[a]
        use = (labels == labels[a]) & (np.arange(6000) != a)
        best = sorted(zip(-score[use], np.flatnonzero(use)))[:5]
        assert [(-s, i) for s, i in zip(goal.scores, goal.ids)] == [(s, i) for s, i in best]
