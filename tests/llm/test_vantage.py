"""Neighbours against brute force: exact with factor one, recall otherwise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import vantage

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def corpus():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    x = np.concatenate([rng.normal(size=(150, 12)), centres[rng.integers(0, 6, 250)] + rng.normal(size=(250, 12)) / 9])
    x = x.astype(np.float32) * rng.choice([0.5, 1, 2], 400)[:, None].astype(np.float32)
    rows = [(i, [float(v) for v in r], 0, "x") for i, r in enumerate(x)]
    rows += [(400 + i, rows[7][1], 0, "x") for i in range(60)]          # copies
    rows += [(500, None, 0, "x"), (501, [0.0] * 12, 0, "x"), (502, [1.0] * 3, 0, "x"),
             (503, [float("nan")] + [1.0] * 11, 0, "x"), (504, [float("inf")] + [1.0] * 11, 0, "x"),
             (505, [None] + [1.0] * 11, 0, "x"), (None, rows[1][1], 0, "x"), (20, rows[20][1], 1, "y")]
    return rows


def brute(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows
            if i is not None and i < 500}
    ids = np.array(sorted(good))
    points = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % 5 == 0]:
        score = (points * good[q]).sum(axis=1)
        keep = ids != q
        top = np.lexsort((ids[keep], -score[keep]))[:k]
        out[int(q)] = [(int(i), float(s)) for i, s in zip(ids[keep][top], score[keep][top])]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    got = {}
    for r in sorted(vantage.nearest(df, F.col("id") % 5 == 0, **options).collect()):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", 130)
    monkeypatch.setattr(vantage, "BLOCK", 30)
    monkeypatch.setattr(vantage, "LEAF", 8)
    rows = corpus()
    assert run(spark, rows, k=20, factor=1.0) == brute(rows, 20)


def test_relaxed_search_has_recall(spark, monkeypatch):
    rows = corpus()
    want, got = brute(rows, 20), run(spark, rows)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("rows", [[], [(5, None, 0, "x")], [(5, [1.0, 2.0], 0, "x")],
                                  [(5, [1.0, 0.0], 0, "x"), (6, [1.0, 0.0], 0, "x")]])
def test_few_rows(spark, rows):
    got = run(spark, rows)
    assert got == ({5: [(6, 1.0)]} if len(rows) == 2 else {})


def test_tree_search_alone():
    rng = np.random.default_rng(3)
    points, queries = rng.normal(size=(500, 6)), rng.normal(size=(40, 6))
    tree = vantage.build(points, rng, leaf=10)
    rows, best = vantage.search(tree, points, queries, np.full(40, np.inf), 7, 1.0)
    away = ((queries[:, None] - points) ** 2).sum(axis=2)
    assert np.allclose(np.sort(best, axis=1), np.sort(away, axis=1)[:, :7])


def recall(want, got, queries):
    assert all(len(got.get(q, [])) == len(want[q]) for q in queries)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in queries)
    return hit / sum(len(want[q]) for q in queries)


def test_one_long_vector_leaves_the_others_their_neighbours(spark, monkeypatch):
    # Several shards, so that most of them lack the long one.
    monkeypatch.setattr(vantage, "SHARD", 400)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1] *= 10
    rows = [(i if i < 500 else i + 10_000, [float(v) for v in r], 0, "x") for i, r in enumerate(x)]
    good = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows}
    ids, points = np.array(list(good)), np.stack(list(good.values()))
    want = {}
    for q in ids[ids % 5 == 0]:
        score = np.where(ids == q, -np.inf, points @ good[q])
        want[int(q)] = [(int(ids[n]), score[n]) for n in np.argsort(-score)[:20]]
    assert recall(want, run(spark, rows), list(want)) >= 0.9


def test_far_queries_of_a_tight_cluster():
    rng = np.random.default_rng(9)
    points = np.eye(12)[0] + rng.normal(size=(3000, 12)) / 50
    queries = rng.normal(size=(40, 12)) * [0, *[1] * 11]
    rows = vantage.search_bands(points, queries, points[:500], 20, vantage.FACTOR)
    best = np.argsort(-(queries @ points.T), axis=1)[:, :20]
    assert (rows >= 0).all()
    assert np.mean([len(set(a) & set(b)) for a, b in zip(rows, best)]) >= 18
    exact = vantage.search_bands(points, queries, points[:500], 20, 1.0)
    assert (np.sort(exact, axis=1) == np.sort(best, axis=1)).all()
