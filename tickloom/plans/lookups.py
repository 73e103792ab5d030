"""Reads over events, captures, sessions and summaries."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import times
from tickloom.operators import lookup
from tickloom.operators.windows import panes, panes_json
from tickloom.plans.registry import query
from tickloom.plans.views import view
from tickloom.sources import events as E, tables

START, END = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20, 12)
BETWEEN = "BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"


@query("S1_window_events_newest", "activity", oracle=f"""
SELECT event_id, ts, bucket, duration, data FROM activity
WHERE bucket = 'aw-watcher-window_host1' AND ts {BETWEEN}
ORDER BY ts DESC, event_id DESC LIMIT 100""")
def window_events_newest(spark, sf):
    found = E.read_window_events(view(spark, sf, "activity"), "host1", start=START, end=END)
    return found.select("event_id", "ts", "bucket", "duration", "data")


@query("S1_window_events_all", "activity", oracle=f"""
SELECT event_id, ts, bucket, duration, data FROM activity
WHERE bucket = 'aw-watcher-window_host1' AND ts {BETWEEN}""")
def window_events_all(spark, sf):
    found = E.read_window_events(
        view(spark, sf, "activity"), "host1", limit=-1, start=START, end=END
    )
    return found.select("event_id", "ts", "bucket", "duration", "data")


@query("S2_afk_events_newest", "activity", oracle="""
SELECT event_id, ts, bucket, duration, data FROM activity
WHERE bucket = 'aw-watcher-afk_host2' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def afk_events_newest(spark, sf):
    return E.read_afk_events(view(spark, sf, "activity"), "host2").select(
        "event_id", "ts", "bucket", "duration", "data"
    )


@query("S3_bucket_id", "activity", oracle="""
SELECT event_id, 'aw-watcher-' || kind || '_' || host AS bucket_id FROM activity""")
def bucket_ids(spark, sf):
    return view(spark, sf, "activity", "event_id", "kind", "host").select(
        "event_id", times.bucket_id(F.col("kind"), F.col("host")).alias("bucket_id")
    )


@query("S4_list_buckets", "activity", oracle="""
SELECT bucket, kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM activity GROUP BY bucket, kind""")
def buckets(spark, sf):
    return E.list_buckets(view(spark, sf, "activity", "bucket", "ts"))


@query("S6_read_captures", "captures", oracle="""
SELECT id, device_id, ts, app, title, text, CAST(NULL AS VARCHAR) AS text_raw, url, idle_s,
 false AS idle, CAST(NULL AS VARCHAR) AS filtered, false AS transition, pid, window_id
FROM captures""")
def read_captures(spark, sf):
    return tables.fill_captures(view(spark, sf, "captures"))


@query("S7_align_schema", "captures", oracle="""
SELECT id, device_id, ts, app, title,
 CASE WHEN app IN ('view', 'click') THEN NULL ELSE window_id END AS window_id FROM captures""")
def aligned(spark, sf):
    # Rows written before windows were told apart, and rows written since.
    rows = view(spark, sf, "captures", "id", "device_id", "ts", "app", "title", "window_id")
    is_old = F.col("app").isin("view", "click")
    old = rows.filter(is_old).drop("window_id")
    both = [tables.align_schema(part, schemas.CAPTURE) for part in (old, rows.filter(~is_old))]
    return both[0].unionByName(both[1]).select(*rows.columns)


@query("K4_known_sessions", "summaries", "known_sessions", oracle="""
SELECT s.id, s.session_id, s.session_id IN (SELECT id FROM known_sessions) AS accepted
FROM summaries s""")
def foreign_key(spark, sf):
    accepted, rejected = tables.split_known_sessions(
        view(spark, sf, "summaries", "id", "session_id"), view(spark, sf, "known_sessions")
    )
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False))
    )


@query("J3_orphan_sessions", "summaries", "known_sessions", oracle="""
SELECT k.id FROM known_sessions k
WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.session_id = k.id)""")
def orphan_sessions(spark, sf):
    used = view(spark, sf, "summaries").select(F.col("session_id").alias("id"))
    return view(spark, sf, "known_sessions", "id").join(used, "id", "left_anti")


@query("K6_json_records", "captures", oracle="""
SELECT id, '{"id":' || id || ',"app":"' || app || '","title":"' || title || '","url":' ||
 CASE WHEN url IS NULL THEN 'null' ELSE '"' || url || '"' END || '}' AS record FROM captures""")
def json_records(spark, sf):
    rows = view(spark, sf, "captures", "id", "app", "title", "url")
    return tables.to_json_records(rows, "id")


@query("F1_capture_by_id", "captures", oracle="SELECT id, ts, app, title FROM captures WHERE id = 77")
def capture_by_id(spark, sf):
    return lookup.by_id(view(spark, sf, "captures", "id", "ts", "app", "title"), 77)


@query("F2_captures_between", "captures", oracle=f"""
SELECT id, device_id, ts, app, title, text, url FROM captures WHERE ts {BETWEEN}""")
def between(spark, sf):
    rows = view(spark, sf, "captures", "id", "device_id", "ts", "app", "title", "text", "url")
    return lookup.captures_between(rows, START, END)


@query("F3_sessions_starting_between", "known_sessions", oracle="""
SELECT id, start_ts, end_ts, app FROM known_sessions
WHERE start_ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 09:30:00'""")
def sessions_starting(spark, sf):
    return lookup.sessions_between(
        view(spark, sf, "known_sessions"), dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 1, 9, 30)
    )


@query("F4_captures_by_app", "captures", oracle="""
SELECT id, device_id, ts, app, title FROM captures WHERE app = 'click'
ORDER BY ts DESC, id LIMIT 500""")
def by_app(spark, sf):
    return lookup.captures_by_app(
        view(spark, sf, "captures", "id", "device_id", "ts", "app", "title"), "click"
    )


@query("T1_most_recent", "captures", oracle="""
SELECT id, device_id, ts, app, title FROM captures ORDER BY ts DESC, id LIMIT 500""")
def recent(spark, sf):
    return lookup.most_recent(view(spark, sf, "captures", "id", "device_id", "ts", "app", "title"))


PANES_JSON = """
WITH panes AS (
 SELECT device_id, tick_ts, '[' || string_agg(
  '{"window_id":' || window_id || ',"app":"' || app || '","pid":' || pid || ',"title":"' || title ||
  '","bounds":{"X":' || bx || ',"Y":' || by_ || ',"Width":' || bw || ',"Height":' || bh || '}}',
  ',' ORDER BY z) || ']' AS panes
 FROM observations GROUP BY device_id, tick_ts)
"""


@query("P11_panes", "observations", oracle=PANES_JSON + "SELECT device_id, tick_ts, panes FROM panes")
def panes_of_ticks(spark, sf):
    return panes(view(spark, sf, "observations")).withColumn("panes", panes_json())


@query("T2_latest_layout", "observations", oracle=PANES_JSON + """
SELECT device_id, max(tick_ts) AS ts, arg_max(panes, tick_ts) AS panes FROM panes GROUP BY device_id
""")
def latest_layout(spark, sf):
    layouts = panes(view(spark, sf, "observations")).select(
        "device_id", F.col("tick_ts").alias("ts"), F.lit(0).alias("id"), panes_json().alias("panes")
    )
    return lookup.latest_per(layouts, ["device_id"], ["ts", "panes"])


@query("T3_frontmost", "observations", oracle="""
SELECT device_id, tick_ts, arg_min(window_id, z) AS window_id, arg_min(app, z) AS app,
 arg_min(id, z) AS id FROM observations GROUP BY device_id, tick_ts""")
def frontmost(spark, sf):
    return lookup.frontmost(
        view(spark, sf, "observations", "id", "device_id", "tick_ts", "z", "window_id", "app"),
        ["window_id", "app", "id"],
    )


@query("P1_event_records", "activity", oracle="""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
 CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS ts,
 'aw' AS source, bucket, duration, coalesce(data, '{}') AS data FROM activity""")
def event_records(spark, sf):
    records = E.to_records(view(spark, sf, "activity"), "event_id")
    return records.withColumn("ts", times.iso(F.col("ts")))


@query("P2_parse_ts", "activity", oracle="""
SELECT event_id, ts AS from_z, ts AS from_offset, ts AS from_naive,
 CAST(NULL AS TIMESTAMP) AS from_junk FROM activity""")
def parsed(spark, sf):
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(
        F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    return view(spark, sf, "activity", "event_id", "ts", "bucket").select(
        "event_id",
        times.parse_ts(F.concat(ts, F.lit("Z"))).alias("from_z"),
        times.parse_ts(F.concat(shifted, F.lit("+02:00"))).alias("from_offset"),
        times.parse_ts(ts).alias("from_naive"),
        times.parse_ts(F.col("bucket")).alias("from_junk"),
    )


@query("P3_seconds_between", "activity", oracle="""
SELECT event_id, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 1e6 AS seconds
FROM activity""")
def distance(spark, sf):
    noon = F.lit(dt.datetime(2024, 1, 15))
    return view(spark, sf, "activity", "event_id", "ts").select(
        "event_id", times.seconds_between(F.col("ts"), noon).alias("seconds")
    )


@query("P10_round_idle", "ticks", oracle="""
SELECT device_id, tick_ts, round(idle_s, 1) AS idle_s FROM ticks""")
def rounded_idle(spark, sf):
    return view(spark, sf, "ticks").withColumn("idle_s", F.round("idle_s", 1))


@query("U1_recent_activity", "activity", oracle="""
SELECT event_id, ts, 'aw' AS source, bucket, duration, coalesce(data, '{}') AS data FROM activity
WHERE ts >= (SELECT max(ts) FROM activity) - INTERVAL 2880 MINUTE""")
def recent_activity(spark, sf):
    return E.recent_activity(view(spark, sf, "activity"), minutes=2880)


@query("T5_merged_time_order", "activity", oracle="""
SELECT event_id, ts, bucket FROM activity
WHERE bucket IN ('aw-watcher-window_host3', 'aw-watcher-afk_host3')""")
def merged(spark, sf):
    events = view(spark, sf, "activity", "event_id", "ts", "bucket")
    window = E.read_window_events(events, "host3", limit=-1)
    afk = E.read_afk_events(events, "host3", limit=-1)
    return window.unionByName(afk).orderBy("ts", "event_id")


@query("J2_summaries_of_sessions", "summaries", "known_sessions", oracle="""
SELECT s.id, s.session_id, s.model, s.created_ts FROM summaries s
WHERE s.session_id IN (SELECT id FROM known_sessions)""")
def session_summaries(spark, sf):
    return lookup.summaries_for(
        view(spark, sf, "known_sessions"),
        view(spark, sf, "summaries", "id", "session_id", "model", "created_ts"),
    )


@query("D10_merged_log", "captures", "activity", oracle="""
SELECT ts, 'screen' AS source, '{"app":"' || app || '","title":"' || title || '","text":"' || text
 || '"}' AS payload, CAST(ts AS DATE) AS date FROM captures
UNION ALL
SELECT ts, 'aw', '{"bucket":"' || bucket || '","duration":' || CAST(duration AS VARCHAR)
 || ',"data":"' || replace(coalesce(data, '{}'), '"', '\\"') || '"}', CAST(ts AS DATE) FROM activity""")
def merged_log(spark, sf):
    return E.merge_streams(
        view(spark, sf, "captures"), E.to_records(view(spark, sf, "activity"))
    )
