"""What is written is read back: appends, rejected rows, JSON lines, failed captures."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tickloom import settings as S
from tickloom.operators import idle, lookup
from tickloom.operators.windows import panes
from tickloom.plans.registry import query
from tickloom.plans.sequences import DAY_TICKS, LAYOUTS, day_ticks, layout_text
from tickloom.plans.views import view
from tickloom.session import stage_folder
from tickloom.sources import events, tables

DAY = 86_400


def _new(spark, name):
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _both(spark, path, name, rejected, *columns):
    """Stored and rejected rows, told apart."""
    stored = tables.read_table(spark, path, name)
    return stored.select(*columns, F.lit(True).alias("stored")).unionByName(
        rejected.select(*columns, F.lit(False).alias("stored")))


BROKEN = "concat('{\"id\": ', CAST(id AS STRING), ', \"app\": \"')"


def _lines(spark, sf):
    """Captures as lines, written as a recorder writes them; every tenth window is cut short."""
    rows = view(spark, sf, "captures", "id", "device_id", "ts", "app", "title", "text", "url", "pid", "window_id")
    record = F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
    line = F.when(F.col("id") % 10 == 3, F.expr(BROKEN)).otherwise(record)
    path = _new(spark, "lines")
    rows.select(line.alias("value")).unionByName(rows.limit(5).select(F.lit("").alias("value"))).write.text(path)
    return tables.read_captures_jsonl(spark, path)


@query("S5_read_json_lines", "captures", oracle="""
SELECT id, device_id, ts, app, title, text, url, pid, window_id FROM captures WHERE id % 10 <> 3""")
def json_lines(spark, sf):
    read = _lines(spark, sf)
    return read.filter(F.col(tables.CORRUPT).isNull()).select(
        "id", "device_id", "ts", "app", "title", "text", "url", "pid", "window_id")


@query("P12_failed_captures", "captures", oracle=f"""
SELECT CASE WHEN id % 10 <> 3 THEN id END AS id, CASE WHEN id % 10 = 3 THEN '{S.ERROR_APP}' ELSE app END AS app,
 CASE WHEN id % 10 = 3 THEN '' ELSE title END AS title,
 CASE WHEN id % 10 = 3 THEN 'capture failed: ' || '{{"id": ' || id || ', "app": "' ELSE text END AS text,
 CASE WHEN id % 10 = 3 THEN -1 ELSE pid END AS pid FROM captures""")
def failed(spark, sf):
    marked = tables.quarantine(_lines(spark, sf))
    # What a broken line still gives is not relied on.
    return marked.select(
        F.when(F.col("app") != S.ERROR_APP, F.col("id")).alias("id"), "app", "title", "text", "pid")


@query("K1_append_captures", "captures", oracle="""
SELECT id, ts, CASE WHEN id % 7 <> 2 THEN app END AS app, title, url, false AS idle, false AS transition,
 id % 7 <> 2 AS stored FROM captures""")
def append_captures(spark, sf):
    rows = view(spark, sf, "captures", "id", "device_id", "ts", "app", "title", "url")
    rows = rows.withColumn("app", F.when(F.col("id") % 7 != 2, F.col("app")))
    path = _new(spark, "captures")
    # Two appends, the older one without a column.
    first = tables.write_captures(rows.filter("id % 2 = 0"), path)
    second = tables.write_captures(rows.filter("id % 2 <> 0"), path)
    return _both(spark, path, "captures", first.unionByName(second),
                 "id", "ts", "app", "title", "url", "idle", "transition")


@query("K1_append_again", "captures", oracle="""
SELECT id, ts, app, title, id % 2 = 0 AS named FROM captures""")
def append_again(spark, sf):
    """Appends that were run twice, with and without a batch name."""
    rows = view(spark, sf, "captures", "id", "ts", "app", "title")
    path = _new(spark, "captures")
    for _ in range(2):
        tables.write_captures(rows.filter("id % 2 = 0"), path, "even")
        tables.write_captures(rows.filter("id % 2 <> 0"), path)
    named = spark.read.parquet(path).select("id", "ts", "app", "title", (F.col("batch") == "even").alias("named"))
    return named


@query("F2_stored_captures_between", "captures", oracle="""
SELECT id, ts, app, CAST(ts AS DATE) AS date FROM captures
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def stored_between(spark, sf):
    path = _new(spark, "captures")
    tables.write_captures(view(spark, sf, "captures", "id", "device_id", "ts", "app", "title"), path, "all")
    found = lookup.captures_between(
        tables.read_table(spark, path, "captures"), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20, 12))
    return found.select("id", "ts", "app", "date")


@query("F2_stored_captures_during", "captures", oracle="""
WITH spans AS (SELECT device_id, ts AS start_ts, ts + INTERVAL 3 HOUR AS end_ts FROM captures
 WHERE app = 'purchase' AND id % 50 = 0)
SELECT id, ts, app FROM captures c WHERE EXISTS (
 SELECT 1 FROM spans s WHERE s.device_id = c.device_id AND c.ts BETWEEN s.start_ts AND s.end_ts)""")
def stored_during(spark, sf):
    """What was on screen in the hours after some purchases."""
    rows = view(spark, sf, "captures", "id", "device_id", "ts", "app", "title")
    path = _new(spark, "captures")
    tables.write_captures(rows, path, "all")
    spans = rows.filter("app = 'purchase' AND id % 50 = 0").select(
        "device_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("end_ts"))
    return lookup.captures_during(tables.read_table(spark, path, "captures"), spans).select("id", "ts", "app")


@query("F3_stored_sessions_between", "known_sessions", oracle="""
SELECT id, start_ts, end_ts, app FROM known_sessions
WHERE start_ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 09:30:00'""")
def stored_sessions(spark, sf):
    path = _new(spark, "sessions")
    tables.write_sessions(view(spark, sf, "known_sessions"), path, "all")
    return lookup.sessions_between(
        tables.read_table(spark, path, "sessions"), dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 1, 9, 30)
    ).select("id", "start_ts", "end_ts", "app")


@query("D10_day_log", "captures", "activity", oracle="""
WITH log AS (
 SELECT ts, 'screen' AS source, '{"app":"' || app || '","title":"' || title || '","text":"' || text
  || '"}' AS payload FROM captures
 UNION ALL
 SELECT ts, 'aw', '{"bucket":"' || bucket || '","duration":' || CAST(duration AS VARCHAR)
  || ',"data":"' || replace(coalesce(data, '{}'), '"', '\\"') || '"}' FROM activity)
SELECT ts, source, payload, CAST(ts AS DATE) AS date FROM log
WHERE ts >= TIMESTAMP '2024-01-05' AND (CAST(ts AS DATE) <> DATE '2024-01-08' OR source = 'screen')""")
def day_log(spark, sf):
    """The log by days, one of which is written again without its activity."""
    log = events.merge_streams(view(spark, sf, "captures"), events.to_records(view(spark, sf, "activity")))
    path = _new(spark, "log")
    events.write_log(log, path)
    events.write_log(log.filter("date = DATE '2024-01-08' AND source = 'screen'"), path)
    return events.read_log(spark, path, dt.date(2024, 1, 5))


@query("K2_append_layout", "observations", oracle="""
SELECT device_id, tick_ts AS ts, CASE WHEN device_id % 5 <> 1 THEN count(*) END AS n_panes,
 device_id % 5 <> 1 AS stored FROM observations GROUP BY device_id, tick_ts""")
def append_layout(spark, sf):
    shown = panes(view(spark, sf, "observations")).select(
        "device_id", F.col("tick_ts").alias("ts"),
        F.when(F.col("device_id") % 5 != 1, F.col("panes")).alias("panes"))
    path = _new(spark, "layout")
    rejected = tables.write_layout(shown, path)
    both = _both(spark, path, "layout", rejected, "id", "device_id", "ts", "panes")
    return both.select("device_id", "ts", F.when(
        F.col("panes").isNotNull(), F.size("panes").cast("long")).alias("n_panes"), "stored")


@query("K3_append_sessions", "known_sessions", oracle="""
SELECT id, start_ts, end_ts, CASE WHEN id % 4 <> 1 THEN app END AS app, id % 4 <> 1 AS stored
FROM known_sessions""")
def append_sessions(spark, sf):
    rows = view(spark, sf, "known_sessions")
    rows = rows.withColumn("app", F.when(F.col("id") % 4 != 1, F.col("app")))
    path = _new(spark, "sessions")
    rejected = tables.write_sessions(rows, path)
    return _both(spark, path, "sessions", rejected, "id", "start_ts", "end_ts", "app")


@query("K4_append_summaries", "summaries", "known_sessions", oracle="""
SELECT s.id, s.session_id, s.created_ts, s.session_id IN (SELECT id FROM known_sessions) AS stored
FROM summaries s""")
def append_summaries(spark, sf):
    path = _new(spark, "summaries")
    rejected = tables.write_summaries(
        view(spark, sf, "summaries"), view(spark, sf, "known_sessions", "id"), path)
    return _both(spark, path, "session_summaries", rejected, "id", "session_id", "created_ts")


# On every third day no window is seen at all; such ticks change nothing.
SEEN = "(SELECT * FROM observations WHERE extract(doy FROM tick_ts) % 3 <> 0)"


@query("F14_empty_ticks", "observations", oracle=DAY_TICKS + LAYOUTS.format(source=SEEN) + """
SELECT device_id, ts, layout FROM changes""")
def empty_ticks(spark, sf):
    seen = view(spark, sf, "observations")
    epochs = idle.active_epochs(idle.idle_segments(day_ticks(seen), slice_s=3 * DAY))
    shown = seen.filter(F.dayofyear("tick_ts") % 3 != 0).join(epochs, ["device_id", "tick_ts"])
    return layout_text(idle.layout_changes(shown, slice_s=3 * DAY))
