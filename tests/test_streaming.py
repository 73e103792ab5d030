"""The stream gives what the batch gives."""

import datetime as dt
import json
import random

from pyspark.sql import Row, functions as F

from tickloom.operators.dedup import CaptureRule
from tickloom.operators.windows import panes_json
from tickloom.plans.batch_loop import CaptureLoop
from tickloom.plans.views import in_order
from tickloom.session import stage_folder
from tickloom.streaming import capture_loop
from tickloom.streaming.capture_loop import INPUT, Epochs, Kept, loop_rows, run_stream, start_loop
from tickloom.streaming.rolling import rolling_activity

T0 = dt.datetime(2026, 4, 5, 10, 0, 0)
BOUNDS = "STRUCT<X INT, Y INT, Width INT, Height INT>"
OBS = ("id long, device_id long, tick_ts timestamp, z long, layer int, app string, window_id long,"
       f" pid int, title string, ax_title string, identifier string, descr string, subrole string,"
       f" hidden boolean, matched boolean, page_url string, texts array<string>, bounds {BOUNDS},"
       " idle_s double")


def recording(seed, n_ticks=150, devices=3):
    rng = random.Random(seed)
    ticks, obs, i = [], [], 0
    for d in range(devices):
        screen = []
        for t in range(n_ticks):
            ts = T0 + dt.timedelta(seconds=3 * t)
            away = 40 <= t % 75 < 45
            ticks.append((d, ts, 200.0 + t if away else 1.0))
            if rng.random() < 0.15 or not screen:
                screen = [(rng.randrange(4), rng.choice(["Arc", "Notes", "1Password"]),
                           rng.choice(["A", "B", "My incognito tab"])) for _ in range(rng.randrange(1, 4))]
            for z, (w, app, title) in enumerate(screen):
                i += 1
                obs.append((i, d, ts, z, 0, app, w, 7, title, title, None, None, None,
                            rng.random() < 0.02, rng.random() < 0.9, "https://e.org/?token=1&a=2",
                            [f"00:{t % 60:02d}", "Mic is on", "Hang Up", "Speaker is on and ready"],
                            (0, 0, 800, 600), 1.0))
    return ticks, obs


def test_stream_equals_batch(spark, tmp_path):
    ticks, obs = recording(3)
    tdf = spark.createDataFrame(ticks, "device_id long, tick_ts timestamp, idle_s double")
    odf = spark.createDataFrame(obs, OBS)
    rows = loop_rows(tdf, odf)

    # Five files in time order, with a tenth of the rows one file late, and a
    # last row of an unused device that moves the watermark to the end.
    rng = random.Random(1)
    collected = [r.asDict() for r in rows.collect()]
    files = [[] for _ in range(6)]
    for r in collected:
        n = int((r["ts"] - T0).total_seconds() // 90)
        files[min(n + (rng.random() < 0.1), 5)].append(r)
    beat = {f.name: None for f in INPUT.fields}
    files.append([{**beat, "device_id": 99, "ts": T0 + dt.timedelta(days=1), "idle_s": 0.0}])
    source = tmp_path / "in"
    for n, part in enumerate(files):
        spark.createDataFrame(part, INPUT).coalesce(1).write.mode("append").parquet(str(source / f"f{n}"))

    stream = (
        spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(source))
    )
    # Files may be taken in any order within the watermark's delay.
    out = run_stream(stream, late="30 minutes")
    query = start_loop(out, str(tmp_path / "out"), str(tmp_path / "check"), seconds=None)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("device_id <> 99")

    want = CaptureLoop(tdf, odf)
    cols = ["id", "device_id", "ts", "app", "title", "text", "url", "filtered", "window_id"]
    assert _rows(got.filter("kind = 'capture'"), cols) == _rows(want.captures, cols)
    assert _rows(got.filter("kind = 'layout'"), ["device_id", "ts", "panes"]) == _rows(
        want.layouts.withColumn("panes", panes_json()), ["device_id", "ts", "panes"])
    idle = ["device_id", "ts", "app", "idle_s", "idle", "pid"]
    assert _rows(got.filter("kind = 'idle'"), idle) == _rows(want.idle_markers, idle)
    assert got.filter("kind = 'idle'").count() == 3 * 2
    kept = got.filter("kind = 'capture'")
    assert kept.filter("filtered IS NOT NULL AND (text <> '' OR url IS NOT NULL)").count() == 0
    assert kept.filter("url LIKE '%token=1%'").count() == 0


def test_late_rows_are_counted(spark, tmp_path):
    """What the engine drops is in a table, by device; a busy device's captures spread out."""
    ticks, obs = recording(5, n_ticks=40, devices=2)
    rows = loop_rows(spark.createDataFrame(ticks, "device_id long, tick_ts timestamp, idle_s double"),
                     spark.createDataFrame(obs, OBS))
    cut = F.lit(T0 + dt.timedelta(seconds=60))
    parts = [F.col("ts") > cut, F.lit(False), (F.col("ts") <= cut) & (F.col("device_id") == 1)]
    for n, part in enumerate(parts):
        piece = rows.filter(part) if n != 1 else rows.filter("device_id = 0").limit(1).withColumn(
            "ts", F.lit(T0 + dt.timedelta(days=1)))
        piece.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{n}"))
    stream = (spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    out = run_stream(stream, late="5 seconds")
    # The captures meet their ticks by (device, instant), and are judged by window and epoch.
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithStateInPySpark") == 2 and "Join LeftOuter" in plan
    start_loop(out, str(tmp_path / "out"), str(tmp_path / "check"), seconds=None).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("table = 'late'")
    assert {r["device_id"]: r["n"] for r in got.groupBy("device_id").agg(F.sum("n").alias("n")).collect()} == {
        1: rows.filter(parts[2]).count()}


class Handle:
    """State of one key in memory; counts how often it is used."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, []

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def registerTimer(self, millis):
        self.calls += 1
        self.timers.append(millis)

    def exists(self):
        return self.get() is not None

    def get(self, key=None):
        self.calls += 1
        return self.values.get(key)

    def update(self, value, key=None):
        self.calls += 1
        self.values[key] = value

    def clear(self):
        self.calls += 1
        self.values.pop(None, None)

    def updateValue(self, key, value):
        self.update(value, key)

    getValue = get


class Watermark:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis


def test_state_is_used_by_bucket_not_by_window():
    """A bucket costs the same few round trips whatever it holds; what no longer matters is not stored."""
    def rows(n, epoch, ts):
        return [Row(kind="tick", device_id=i, window=1, known=True, epoch=epoch, micros=ts, z=0, id=i, app="a", title="t",
                    text="same text", url=None, pid=1, window_id=1, idle_s=0.0, filtered=None) for i in range(n)]

    calls = []
    for n in (2, 500):
        handle, rule = Handle(), CaptureRule(0.85, 45)
        kept = Kept(rule, 2000)
        kept.init(handle)
        assert len(list(kept.handleInputRows((0,), iter(rows(n, 0, 1_000_000)), Watermark(2000)))) == n
        assert list(kept.handleInputRows((0,), iter(rows(n, 0, 4_000_000)), Watermark(5000))) == []
        assert len(list(kept.handleInputRows((0,), iter(rows(n, 1, 7_000_000)), Watermark(8000)))) == n
        list(kept.handleExpiredTimer((0,), Watermark(46_000), None))
        assert kept._stored() and handle.timers == [46_000, 52_000]
        list(kept.handleExpiredTimer((0,), Watermark(52_000), None))
        assert not handle.values
        # A snapshot is due already.
        list(kept.handleInputRows((0,), iter(rows(n, 1, 60_000_000)), Watermark(200_000)))
        assert not handle.values and len(handle.timers) == 2
        calls.append(handle.calls)
    assert calls[0] == calls[1] <= 15


def test_a_bucket_of_devices_is_held_in_entries(monkeypatch):
    monkeypatch.setattr(capture_loop, "_ENTRY", 7)
    handle, epochs = Handle(), Epochs(180, 600)
    epochs.init(handle)
    rows = [Row(micros=1_000_000 * t, device_id=d, z=None, window_id=None, pane_app=None, pane_title=None, pane=None,
                matched=None, idle_s=200.0 if t > 7 else 1.0) for t in range(10) for d in (1, 2)]
    taken = list(epochs.handleInputRows((0,), iter(rows), Watermark(0)))
    assert [(r.kind, r.device_id, r.n) for r in taken] == [("taken", 1, 10), ("taken", 2, 10)]
    entries = {k: json.loads(v[0]) for k, v in handle.values.items() if k is not None}
    assert [len(e) for e in entries.values()] == [7, 7, 6]
    handle.keys = lambda: iter([k for k in handle.values if k is not None])
    handle.removeKey = lambda key: handle.values.pop(key)
    found = list(epochs.handleExpiredTimer((0,), Watermark(8_000), None))
    assert [(r.kind, r.device_id, r.ts.second) for r in found] == [("idle", 1, 8), ("idle", 2, 8)]
    left = [row for k, v in handle.values.items() if k is not None for row in json.loads(v[0])]
    assert [(row[0], row[1]) for row in left] == [(9_000_000, 1), (9_000_000, 2)]
    assert list(epochs.handleExpiredTimer((0,), Watermark(9_000), None)) == []


def test_parts_in_order_are_written_by_all_tasks(spark):
    df = spark.range(1000).repartition(4)
    stream = in_order(spark, df, "id < 600", "id > 5000", "id >= 600")
    seen = {}
    stream.writeStream.foreachBatch(
        lambda batch, n: seen.update({n: (sorted(r.id for r in batch.collect()), len(batch.inputFiles()))})
    ).trigger(availableNow=True).start().awaitTermination()
    assert {n: rows for n, (rows, _) in seen.items()} == {0: list(range(600)), 1: [], 2: list(range(600, 1000))}
    files = [r.f for r in spark.read.option("recursiveFileLookup", "true").schema("id long").parquet(
        f"{stage_folder(spark)}/source-*/parts/0").select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) >= 4


def _rows(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_rolling_stream(spark, tmp_path):
    rows = [(f"b{i % 2}", T0 + dt.timedelta(seconds=20 * i), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "bucket string, ts timestamp, duration double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        rolling_activity(stream).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    end = T0 + dt.timedelta(seconds=20 * 199) - dt.timedelta(minutes=10)
    want = rolling_activity(df).filter(F.col("window_end") <= F.lit(end))
    assert got.count() > 0
    assert _rows(got, got.columns) == _rows(want, got.columns)
