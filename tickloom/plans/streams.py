"""The capture loop run as a stream over the given events."""

import uuid

from pyspark.sql import functions as F

from tickloom import settings as S
from tickloom.plans.matching import unlike_sql
from tickloom.plans.registry import query
from tickloom.plans.reports import SESSIONS
from tickloom.plans.sequences import LOOP_KEYS, LOOP_ROWS, SNAPSHOT_S, kept_sql
from tickloom.plans.views import in_order, shaped, table_stream, view
from tickloom.session import SETTINGS, stage_folder
from tickloom.streaming.capture_loop import OUTPUT, loop_rows, run_stream, start_loop
from tickloom.streaming.rolling import rolling_activity
from tickloom.streaming.sessions import ended_sessions

STORE = "spark.sql.streaming.stateStore.providerClass"


def capture_stream(spark, sf, threshold=0, prepare=lambda seen: seen):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(STORE, SETTINGS[STORE])
    seen = prepare(shaped(table_stream(spark, sf, "events"), "observations"))
    rows = loop_rows(seen.select("device_id", "tick_ts", "idle_s"), seen)
    return _run(spark, rows, late="0 seconds", threshold=threshold)


def _run(spark, rows, late, threshold=0):
    # Events of one user are hours apart, so a slot is as long as some weeks.
    out = run_stream(rows, late=late, threshold=threshold, forced_snapshot_s=SNAPSHOT_S, slot_s=2 * SNAPSHOT_S)
    base = f"{stage_folder(spark)}/loop-{uuid.uuid4().hex}"
    start_loop(out, f"{base}/tables", f"{base}/progress", seconds=None).awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{base}/tables")


@query("G1_stream_captures", "observations", oracle=LOOP_ROWS + unlike_sql("active", LOOP_KEYS, 10).strip() + kept_sql(
    "active", LOOP_KEYS, 10, "EXISTS (SELECT 1 FROM unlike u WHERE u.id = s.id AND u.kid = r.kid)") + """
SELECT a.id, a.device_id, a.ts, a.app, a.title, a.text, a.url, a.filtered
FROM walk w JOIN active a ON a.id = w.id WHERE w.keep""")
def stream_captures(spark, sf):
    """All rules, with text similarity."""
    out = capture_stream(spark, sf, threshold=S.SIMILARITY_THRESHOLD)
    return out.filter(F.col("kind") == "capture").select(
        "id", "device_id", "ts", "app", "title", "text", "url", "filtered"
    )


@query("G3_stream_idle_markers", "observations", oracle="""
WITH ticks AS (SELECT device_id, tick_ts, max(idle_s) AS idle_s FROM observations GROUP BY ALL),
looked AS (SELECT *, idle_s >= 180 AS i, coalesce(lag(idle_s >= 180)
 OVER (PARTITION BY device_id ORDER BY tick_ts), false) AS was FROM ticks)
SELECT device_id, tick_ts AS ts, idle_s, true AS idle FROM looked WHERE i AND NOT was""")
def stream_idle(spark, sf):
    return capture_stream(spark, sf).filter(F.col("kind") == "idle").select(
        "device_id", "ts", "idle_s", "idle"
    )



# The rows of every ninth device come last. Rows are late by the watermark that
# the micro-batch before theirs started with: two days before the newest tick of
# the first file. What is older is lost.
FIRST, LATE = "device_id % 9 <> 4 AND device_id % 2 = 0", "device_id % 9 = 4"


@query("G3_stream_late_rows", "observations", oracle=f"""
WITH mark AS (SELECT max(tick_ts) - INTERVAL 2 DAY AS mark_ts FROM observations WHERE {FIRST}),
taken AS (SELECT o.* FROM observations o, mark WHERE NOT ({LATE}) OR o.tick_ts > mark.mark_ts),
ticks AS (SELECT device_id, tick_ts, max(idle_s) AS idle_s FROM taken GROUP BY ALL),
ready AS (SELECT t.* FROM ticks t WHERE tick_ts <= (SELECT max(tick_ts) FROM taken) - INTERVAL 2 DAY
 OR tick_ts <= (SELECT mark_ts FROM mark)),
looked AS (SELECT *, idle_s >= 180 AS i, coalesce(lag(idle_s >= 180)
 OVER (PARTITION BY device_id ORDER BY tick_ts), false) AS was FROM ready)
SELECT device_id, tick_ts AS ts, idle_s, true AS idle FROM looked WHERE i AND NOT was""")
def stream_late(spark, sf):
    spark.conf.set(STORE, SETTINGS[STORE])
    seen = view(spark, sf, "observations")
    rows = loop_rows(seen.select("device_id", "tick_ts", "idle_s"), seen)
    stream = in_order(spark, rows, FIRST, f"NOT ({FIRST}) AND NOT ({LATE})", LATE)
    return _run(spark, stream, late="2 days").filter(F.col("kind") == "idle").select(
        "device_id", "ts", "idle_s", "idle"
    )


@query("G3_late_counts", "observations", oracle=f"""
WITH mark AS (SELECT max(tick_ts) - INTERVAL 2 DAY AS mark_ts FROM observations WHERE {FIRST})
SELECT device_id, count(*) AS n_late FROM observations, mark
WHERE {LATE} AND tick_ts <= mark_ts GROUP BY device_id""")
def late_counts(spark, sf):
    """How many rows of each device came too late."""
    spark.conf.set(STORE, SETTINGS[STORE])
    seen = view(spark, sf, "observations")
    beats = loop_rows(seen.select("device_id", "tick_ts", "idle_s"), seen).filter("z IS NULL")
    stream = in_order(spark, beats, FIRST, f"NOT ({FIRST}) AND NOT ({LATE})", LATE)
    late = _run(spark, stream, late="2 days").filter(F.col("kind") == "late")
    return late.groupBy("device_id").agg(F.sum("n").alias("n_late"))


@query("G2_rolling_stream", "activity", oracle="""
WITH hours AS (
 SELECT bucket, duration, unnest(generate_series(
  date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS window_start
 FROM activity)
SELECT bucket, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n_events,
 round(sum(duration), 4) AS total_s FROM hours
WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM activity) - INTERVAL 10 MINUTE
GROUP BY bucket, window_start""")
def rolling_stream(spark, sf):
    """Rolling activity as a stream: windows are final once the watermark is past them."""
    spark.conf.set(STORE, SETTINGS[STORE])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stream = shaped(table_stream(spark, sf, "events"), "activity", "bucket", "ts", "duration")
    found = _finished(spark, rolling_activity(stream, "6 hours", "1 hour"))
    return found.withColumn("total_s", F.round("total_s", 4))


def _finished(spark, rows):
    """What a stream gives until all of its source is taken."""
    base = f"{stage_folder(spark)}/stream-{uuid.uuid4().hex}"
    (
        rows.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
        .start(f"{base}/out").awaitTermination()
    )
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query("D2_sessions_stream", "captures", oracle=SESSIONS + """
SELECT device_id, app, title, start_ts, end_ts, CASE WHEN url = '' THEN NULL ELSE url END AS url,
 capture_count, duration_s FROM found
WHERE end_ts + INTERVAL 2 DAY <= (SELECT max(ts) FROM captures) - INTERVAL 1 MINUTE""")
def sessions_stream(spark, sf):
    """Sessions as a stream: final once the watermark is past their gap."""
    spark.conf.set(STORE, SETTINGS[STORE])
    stream = shaped(table_stream(spark, sf, "events"), "captures", "id", "device_id", "ts", "app", "title", "url")
    return _finished(spark, ended_sessions(stream, gap_s=2 * 86_400))
