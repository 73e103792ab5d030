"""Sliced sequence operators against plain window functions and loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from tickloom.operators.sequence import Order, asof_join, segments, trailing_window, with_earlier
from tickloom.operators.sessions import focus_ends, sessions, switch_bursts

T0 = dt.datetime(2026, 4, 5, 10, 0, 0)


def rows(seed, n, keys=3, steps=(1, 5, 40, 400)):
    rng = random.Random(seed)
    t, out = T0, []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice(steps) * rng.choice([0, 1, 1, 1]))
        out.append((rng.choice([0] * 5 + list(range(keys))), i, t,
                    rng.choice(["a", "a", "b", None]), "t", None, rng.random() * 10))
    return out


SCHEMA = "device_id long, id long, ts timestamp, app string, title string, url string, v double"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slice_s", [10, 600, 10 ** 7])
def test_with_earlier(spark, seed, slice_s):
    df = spark.createDataFrame(rows(seed, 400), SCHEMA)
    w = Window.partitionBy("device_id").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "id", F.lag("app").over(w).alias("p"), F.last("app", True).over(upto).alias("l"),
        F.count("app").over(upto).alias("r"),
    )
    got = with_earlier(
        df, ["device_id"], Order(), previous={"p": F.col("app")}, latest={"l": F.col("app")},
        running={"r": F.when(F.col("app").isNotNull(), 1).otherwise(0)}, slice_s=slice_s,
    ).select("id", "p", "l", "r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("seed", [3, 4, 5])
@pytest.mark.parametrize("slice_s", [10, 130, 3000, 10 ** 7])
def test_segments_by_gap(spark, seed, slice_s):
    data = rows(seed, 300)
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted(
        (r.device_id, r.app or "", r.start_ts, r.end_ts, r.capture_count)
        for r in sessions(df, 120, slice_s=slice_s).collect()
    )
    want = {}
    for dev, i, ts, app, *_ in sorted(data, key=lambda r: (r[2], r[1])):
        runs = want.setdefault((dev, app or ""), [])
        if runs and (ts - runs[-1][1]).total_seconds() < 120:
            runs[-1][1] = ts
            runs[-1][2] += 1
        else:
            runs.append([ts, ts, 1])
    assert got == sorted((*k, *r) for k, rs in want.items() for r in rs)


@pytest.mark.parametrize("slice_s", [10, 130, 3000, 10 ** 7])
def test_segments_by_change(spark, slice_s):
    data = rows(6, 300, steps=(1, 5, 40))
    df = spark.createDataFrame(data, SCHEMA)
    cut = segments(
        df, ["device_id"], Order(), ["app", "id"],
        lambda b, h: ~b("app").eqNullSafe(h("app")), sums=["v"], slice_s=slice_s,
    )
    got = sorted((r.device_id, r["head"]["id"], r.tail.id, r.n, round(r.sum_v, 6)) for r in cut.collect())
    want, by_dev = [], {}
    for r in sorted(data, key=lambda r: (r[2], r[1])):
        runs = by_dev.setdefault(r[0], [])
        if runs and runs[-1][-1][3] == r[3]:
            runs[-1].append(r)
        else:
            runs.append([r])
    for dev, runs in by_dev.items():
        for run in runs:
            want.append((dev, run[0][1], run[-1][1], len(run), round(sum(x[6] for x in run), 6)))
    assert got == sorted(want)
    ends = focus_ends(df, 30, slice_s=slice_s)
    want_ends = sorted(
        (dev, runs[i + 1][0][2], (runs[i][-1][2] - runs[i][0][2]).total_seconds())
        for dev, runs in by_dev.items() for i in range(len(runs) - 1)
        if (runs[i][-1][2] - runs[i][0][2]).total_seconds() > 30
    )
    assert sorted((r.device_id, r.switch_ts, r.focus_s) for r in ends.collect()) == want_ends


@pytest.mark.parametrize("slice_s", [10, 600, 10 ** 7])
def test_asof(spark, slice_s):
    left = rows(7, 120)
    right = rows(8, 150)
    ldf = spark.createDataFrame(left, SCHEMA).select("device_id", F.col("id").alias("lid"), F.col("ts").alias("at"))
    rdf = spark.createDataFrame(right, SCHEMA).select("device_id", "id", "ts", "app")
    got = asof_join(ldf, rdf, ["device_id"], "at", "ts", "id", ["id", "app"], slice_s)
    want = []
    for dev, i, ts, *_ in left:
        best = max(((r[2], r[1], r[3]) for r in right if r[0] == dev and r[2] <= ts),
                   key=lambda b: b[:2], default=None)
        want.append((i, best[1] if best else None, best[2] if best else None))
    key = lambda t: t[0]
    assert sorted(((r.lid, r.id, r.app) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("slice_s", [10, 600, 10 ** 7])
def test_trailing_window(spark, slice_s):
    data = rows(9, 300)
    df = spark.createDataFrame(data, SCHEMA)
    spread, w = trailing_window(df, ["device_id"], "ts", 300, slice_s)
    got = sorted(
        (r.id, r.n) for r in
        spread.withColumn("n", F.count(F.lit(1)).over(w)).filter(~F.col("_carry")).collect()
    )
    want = sorted(
        (i, sum(1 for r in data if r[0] == dev and 0 <= (ts - r[2]).total_seconds() <= 300))
        for dev, i, ts, *_ in data
    )
    assert got == want


def test_switch_bursts(spark):
    data = [(1, i, T0 + dt.timedelta(seconds=20 * i), "ab"[i % 2], "t", None, 0.0) for i in range(40)]
    got = switch_bursts(spark.createDataFrame(data, SCHEMA), 8, 300, slice_s=100).collect()
    # 16 switches fit in 300 s with both ends; the first switch is row 1.
    assert sorted((r.id, r.n_switches) for r in got) == [
        (i, min(i, 16)) for i in range(8, 40)
    ]
