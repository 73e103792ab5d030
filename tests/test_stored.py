"""Appends that run again, days that are not read, long lists, the log by days."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickloom.operators import capture as C, lookup, sessions as R
from tickloom.operators.lists import listed
from tickloom.sources import events as E, tables
from tickloom.streaming.sessions import ended_sessions

T0 = dt.datetime(2026, 4, 5, 10)


def captures(spark, n=400, days=40, start=0):
    rows = [(i % 7, T0 + dt.timedelta(days=i % days, seconds=i), "Arc" if i % 3 else "Notes", f"t{i}", None)
            for i in range(start, start + n)]
    return spark.createDataFrame(rows, "device_id long, ts timestamp, app string, title string, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_append_that_runs_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    for _ in range(3):
        assert tables.write_captures(captures(spark), path).count() == 0
    tables.write_captures(captures(spark, 500), path)  # a hundred more
    got = tables.read_table(spark, path, "captures")
    assert got.count() == got.select("id").distinct().count() == 500
    tables.write_captures(captures(spark).limit(0), path)
    assert tables.read_table(spark, path, "captures").count() == 500
    # Equal ids at other times or on other devices are other rows.
    clash = [(1, 1, T0, "a", "b"), (1, 2, T0, "a", "b"), (1, 1, T0 + dt.timedelta(1), "a", "b")]
    for row in clash:
        tables.write_captures(
            spark.createDataFrame([row], "id long, device_id long, ts timestamp, app string, title string"), path)
    assert tables.read_table(spark, path, "captures").filter("id = 1").count() == 3


def test_a_named_batch_is_replaced(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_captures(captures(spark, 50), path, "monday")
    tables.write_captures(captures(spark, 50, start=50), path, "tuesday")
    tables.write_captures(captures(spark, 50), path, "monday")
    tables.write_captures(captures(spark, 20, start=100), path)
    assert tables.read_table(spark, path, "captures").count() == 120
    with pytest.raises(ValueError):
        tables.write_captures(captures(spark, 1), path, tables.UNNAMED)


def test_stored_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_captures(captures(spark, days=400), path, "all")
    stored = tables.read_table(spark, path, "captures")
    end = T0 + dt.timedelta(days=2, hours=1)
    day = lookup.captures_between(stored, T0, end)
    assert day.count() == 3 and "PartitionFilters: [isnotnull(date" in plan(day)
    spans = spark.createDataFrame([(5, T0, end), (6, T0 + dt.timedelta(days=6), end + dt.timedelta(days=9)), (0, end, T0)],
                                  "device_id long, start_ts timestamp, end_ts timestamp")
    during = lookup.captures_during(stored, spans)
    want = stored.filter((F.col("device_id") == 6) & F.col("ts").between(
        F.lit(T0 + dt.timedelta(days=6)), F.lit(end + dt.timedelta(days=9))))
    assert sorted(r.id for r in during.collect()) == sorted(r.id for r in want.collect()) and want.count() > 0
    assert "dynamicpruning" in plan(during)
    assert during.columns == stored.columns
    # A table without days, and spans of any device.
    plain = captures(spark)
    assert lookup.captures_during(plain, spans.drop("device_id").limit(1)).count() == plain.filter(
        F.col("ts").between(F.lit(T0), F.lit(end))).count()


def test_sessions_are_pruned_by_day(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(days=i), T0 + dt.timedelta(days=i, hours=1), "Arc") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, start_ts timestamp, end_ts timestamp, app string")
    for _ in range(2):
        tables.write_sessions(df, str(tmp_path / "s"))
    found = lookup.sessions_between(tables.read_table(spark, str(tmp_path / "s"), "sessions"), T0, T0 + dt.timedelta(days=1))
    assert [r.id for r in found.collect()] == [0, 1] and "PartitionFilters: [isnotnull(date" in plan(found)


def test_lists_of_a_million_names(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("App"), F.col("id")).alias("name")).unionByName(
        spark.createDataFrame([("App7",), (None,)], "name string"))
    df = spark.createDataFrame([(1, "aPP7"), (2, "other"), (3, None), (4, "app999999")], "id long, app string")
    marked = C.mark_blocked(df, names, "blocked")
    assert {r.id: r.blocked for r in marked.collect()} == {1: True, 2: False, 3: False, 4: True}
    assert "App7," not in plan(marked) and " IN (" not in plan(marked)
    assert listed(df, F.col("app"), names.limit(0), "x").filter("x").count() == 0
    found = spark.createDataFrame([("App7", 700.0), ("App7", 5.0), ("zzz", 700.0)], "app string, duration_s double")
    assert [tuple(r) for r in R.distraction_dwell(found, names).collect()] == [("App7", 700.0)]


def test_log_by_days(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(T0 + dt.timedelta(days=i % 5, microseconds=i), "screen", f'{{"text": "Zeile\n{i}"}}') for i in range(50)]
    log = spark.createDataFrame(rows, "ts timestamp, source string, payload string").withColumn("date", F.to_date("ts"))
    E.write_log(log, path)
    assert len([f for f in os.listdir(path) if f.startswith("date=")]) == 5
    back = E.read_log(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, log.collect()))
    E.write_log(log.filter("date = DATE '2026-04-06'").limit(3), path)
    E.write_log(log.filter("date = DATE '2026-04-06'").limit(3), path)
    assert E.read_log(spark, path).count() == 43
    days = E.read_log(spark, path, dt.date(2026, 4, 6), dt.date(2026, 4, 7))
    assert days.count() == 13 and "PartitionFilters: [isnotnull(date" in plan(days)


def test_sessions_as_they_end(spark, tmp_path):
    rows = [(i, i % 3, T0 + dt.timedelta(seconds=40 * i + (400 if i > 60 else 0)), "Arc" if i % 20 else "Notes", "t",
             f"u{i}" if i % 4 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, device_id long, ts timestamp, app string, title string, url string")
    batch = R.sessions(df, gap_s=300)
    order = lambda d: sorted(str(r) for r in d.select(sorted(d.columns)).collect())
    assert order(ended_sessions(df, gap_s=300)) == order(batch)
    for n in range(5):
        df.filter(f"id div 30 = {n}").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    (ended_sessions(stream, 300, "90 minutes").writeStream.outputMode("append").format("parquet")
     .option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    mark = max(r[2] for r in rows) - dt.timedelta(minutes=90)
    final = batch.filter(F.col("end_ts") + F.expr("INTERVAL 300 SECONDS") <= F.lit(mark))
    assert order(spark.read.parquet(str(tmp_path / "out"))) == order(final) and final.count() > 0
