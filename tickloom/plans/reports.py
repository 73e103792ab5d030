"""Sessions and attention reports."""

from pyspark.sql import functions as F

from tickloom.functions.text import normalise_text
from tickloom.operators import idle, sessions as R
from tickloom.operators.windows import panes
from tickloom.plans.registry import query
from tickloom.plans.views import table, view
from tickloom.sources import events as E
from tickloom.streaming.rolling import rolling_activity

DAY = 86_400


@query("D1_screen_at", "observations", "captures", oracle="""
WITH moments AS (SELECT device_id, id AS moment_id, ts AS at_ts FROM captures WHERE app = 'purchase'),
panes AS (
 SELECT device_id, tick_ts, window_id, z, row_number() OVER (PARTITION BY device_id, tick_ts ORDER BY z) - 1 AS pos
 FROM observations),
ticks AS (SELECT DISTINCT device_id, tick_ts FROM observations),
placed AS (SELECT m.*, t.tick_ts AS layout_ts FROM moments m ASOF JOIN ticks t
 ON m.device_id = t.device_id AND m.at_ts >= t.tick_ts),
shown AS (SELECT p.*, n.window_id, n.pos AS z FROM placed p JOIN panes n
 ON n.device_id = p.device_id AND n.tick_ts = p.layout_ts)
SELECT s.moment_id, s.layout_ts, s.z, s.window_id, c.ts AS capture_ts, c.app, c.title, c.text
FROM shown s ASOF LEFT JOIN captures c
 ON s.device_id = c.device_id AND s.window_id = c.window_id AND s.at_ts >= c.ts""")
def screen_at(spark, sf):
    captures = view(spark, sf, "captures")
    layouts = panes(view(spark, sf, "observations")).select(
        "device_id", F.col("tick_ts").alias("ts"), F.lit(0).cast("long").alias("id"), "panes"
    )
    moments = captures.filter(F.col("app") == "purchase").select(
        "device_id", F.col("id").alias("moment_id"), F.col("ts").alias("at_ts")
    )
    found = R.screen_at(moments, layouts, captures, slice_s=3 * DAY)
    return found.select("moment_id", "layout_ts", "z", "window_id", "capture_ts", "app", "title", "text")


SESSIONS = """
WITH gaps AS (
 SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), 999999999999999) >= CAST(172800 AS BIGINT) * 1000000 AS starts
 FROM captures WINDOW w AS (PARTITION BY device_id, app, title ORDER BY ts, id)),
numbered AS (
 SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END)
  OVER (PARTITION BY device_id, app, title ORDER BY ts, id) AS no FROM gaps),
found AS (
 SELECT device_id, app, title, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(url_text, (ts, id)) AS url,
  count(*) AS capture_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
 FROM (SELECT *, coalesce(url, '') AS url_text FROM numbered) GROUP BY device_id, app, title, no)
"""


@query("D2_sessions", "captures", oracle=SESSIONS + """
SELECT device_id, app, title, start_ts, end_ts, CASE WHEN url = '' THEN NULL ELSE url END AS url,
 capture_count, duration_s FROM found""")
def sessions(spark, sf):
    return R.sessions(view(spark, sf, "captures"), gap_s=2 * DAY, slice_s=5 * DAY)


@query("D3_normalise", "captures", oracle="""
SELECT id, text_raw, trim(regexp_replace(regexp_replace(regexp_replace(text_raw,
 '[0-9]{2}:[0-9]{2} / [0-9]{2}:[0-9]{2}', '', 'g'), '[0-9,]+ (words|characters)', '', 'g'),
 ' {2,}', ' ', 'g')) AS text FROM (
 SELECT id, '00:' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') || ' / 15:27 ' || text || ' '
  || window_id || ',' || (100 + id % 900) || ' words ' || id || ' characters' AS text_raw FROM captures)""")
def normalised(spark, sf):
    raw = F.concat(
        F.lit("00:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(" / 15:27 "), "text",
        F.lit(" "), F.col("window_id").cast("string"), F.lit(","),
        (100 + F.col("id") % 900).cast("string"), F.lit(" words "),
        F.col("id").cast("string"), F.lit(" characters"),
    )
    return view(spark, sf, "captures").select("id", raw.alias("text_raw")).withColumn(
        "text", normalise_text(F.col("text_raw"))
    )


@query("D4_app_totals", "activity", oracle="""
SELECT device_id, CAST(ts AS DATE) AS day, app, round(sum(duration), 4) AS total_s, count(*) AS n_events
FROM activity GROUP BY ALL""")
def app_totals(spark, sf):
    totals = R.app_totals(view(spark, sf, "activity", "device_id", "ts", "app", "duration"))
    return totals.withColumn("total_s", F.round("total_s", 4))


@query("D5_switch_bursts", "captures", oracle="""
WITH switches AS (SELECT * FROM (
 SELECT *, lag(app) OVER (PARTITION BY device_id ORDER BY ts, id) AS a FROM captures) WHERE a <> app),
counted AS (SELECT id, device_id, ts, count(*) OVER (PARTITION BY device_id ORDER BY ts
 RANGE BETWEEN INTERVAL 345600 SECOND PRECEDING AND CURRENT ROW) AS n_switches FROM switches)
SELECT * FROM counted WHERE n_switches >= 8""")
def switch_bursts(spark, sf):
    return R.switch_bursts(view(spark, sf, "captures", "id", "device_id", "ts", "app"), 8, 4 * DAY, slice_s=5 * DAY)


@query("D6_distraction_dwell", "captures", oracle=SESSIONS + """
SELECT device_id, app, title, start_ts, duration_s FROM found
WHERE app IN ('view', 'click') AND duration_s > 90000""")
def dwell(spark, sf):
    found = R.sessions(view(spark, sf, "captures"), gap_s=2 * DAY, slice_s=5 * DAY)
    return R.distraction_dwell(found, ["view", "click"], 90_000).select(
        "device_id", "app", "title", "start_ts", "duration_s"
    )


@query("D6_dwell_long_list", "captures", oracle=SESSIONS + """
SELECT device_id, app, title, start_ts, duration_s FROM found
WHERE app IN (SELECT event_type FROM events WHERE event_id % 4000 = 17) AND duration_s > 90000""")
def dwell_long_list(spark, sf):
    """Apps to look for that are a table."""
    found = R.sessions(view(spark, sf, "captures"), gap_s=2 * DAY, slice_s=5 * DAY)
    apps = table(spark, sf, "events").filter("event_id % 4000 = 17").select("event_type")
    return R.distraction_dwell(found, apps, 90_000).select("device_id", "app", "title", "start_ts", "duration_s")


@query("D7_focus_ends", "captures", oracle="""
WITH marked AS (SELECT *, coalesce(lag(app) OVER w <> app, true) AS starts FROM captures
 WINDOW w AS (PARTITION BY device_id ORDER BY ts, id)),
numbered AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END)
 OVER (PARTITION BY device_id ORDER BY ts, id) AS no FROM marked),
runs AS (SELECT device_id, no, any_value(app) AS app, min(ts) AS s, max(ts) AS e FROM numbered GROUP BY device_id, no)
SELECT r.device_id, r.app AS focus_app, n.app AS next_app, n.s AS switch_ts,
 (epoch_us(r.e) - epoch_us(r.s)) / 1e6 AS focus_s
FROM runs r JOIN runs n ON n.device_id = r.device_id AND n.no = r.no + 1
WHERE epoch_us(r.e) - epoch_us(r.s) > CAST(43200 AS BIGINT) * 1000000""")
def focus_ends(spark, sf):
    return R.focus_ends(view(spark, sf, "captures", "id", "device_id", "ts", "app"), 43_200, slice_s=3 * DAY)


@query("D8_returns_from_idle", "ticks", oracle="""
WITH flagged AS (SELECT device_id, tick_ts, round(idle_s, 1) >= 90 AS idle FROM ticks),
marked AS (SELECT *, coalesce(lag(idle) OVER w <> idle, true) AS starts FROM flagged
 WINDOW w AS (PARTITION BY device_id ORDER BY tick_ts)),
numbered AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END)
 OVER (PARTITION BY device_id ORDER BY tick_ts) AS no FROM marked),
runs AS (SELECT device_id, no, any_value(idle) AS idle, min(tick_ts) AS s, max(tick_ts) AS e, count(*) AS n
 FROM numbered GROUP BY device_id, no)
SELECT r.device_id, r.s AS start_ts, r.e AS end_ts, r.n, n.s AS return_ts,
 (epoch_us(n.s) - epoch_us(r.s)) / 1e6 AS away_s
FROM runs r JOIN runs n ON n.device_id = r.device_id AND n.no = r.no + 1
WHERE r.idle AND epoch_us(n.s) - epoch_us(r.s) > CAST(43200 AS BIGINT) * 1000000""")
def returns(spark, sf):
    stretches = idle.idle_stretches(view(spark, sf, "ticks"), 90, slice_s=3 * DAY)
    return R.returns_from_idle(stretches, 43_200)


@query("D9_cool_down", "repeats", oracle="""
WITH RECURSIVE seq AS MATERIALIZED (
 SELECT id, device_id, ts, k % 7 = 0 AS dismissed,
  row_number() OVER (PARTITION BY device_id ORDER BY ts, id) AS rn FROM repeats),
walk AS (
 SELECT device_id, id, rn, true AS keep, ts AS kts, dismissed AS kd FROM seq WHERE rn = 1
 UNION ALL
 SELECT s.device_id, s.id, s.rn,
  s.ts - r.kts >= CASE WHEN r.kd THEN INTERVAL 6 DAY ELSE INTERVAL 2 DAY END,
  CASE WHEN s.ts - r.kts >= CASE WHEN r.kd THEN INTERVAL 6 DAY ELSE INTERVAL 2 DAY END THEN s.ts ELSE r.kts END,
  CASE WHEN s.ts - r.kts >= CASE WHEN r.kd THEN INTERVAL 6 DAY ELSE INTERVAL 2 DAY END THEN s.dismissed ELSE r.kd END
 FROM walk r JOIN seq s ON s.device_id = r.device_id AND s.rn = r.rn + 1)
SELECT q.id, q.device_id, q.ts, q.dismissed FROM walk w JOIN seq q ON q.id = w.id WHERE w.keep""")
def cooled(spark, sf):
    triggers = view(spark, sf, "repeats").select(
        "id", "device_id", "ts", (F.col("k") % 7 == 0).alias("dismissed")
    )
    return R.cool_down(triggers, 2 * DAY, 6 * DAY, slice_s=12 * DAY)


@query("D11_screen_share", "observations", oracle="""
WITH ticks AS (SELECT device_id, tick_ts, lead(tick_ts) OVER (PARTITION BY device_id ORDER BY tick_ts) AS next_ts
 FROM (SELECT DISTINCT device_id, tick_ts FROM observations)),
areas AS (
 SELECT o.device_id, o.app, sum(CAST(bw AS DOUBLE) * bh * epoch(next_ts - t.tick_ts)) AS area_s
 FROM observations o JOIN ticks t ON t.device_id = o.device_id AND t.tick_ts = o.tick_ts
 WHERE next_ts IS NOT NULL GROUP BY o.device_id, o.app)
SELECT device_id, app, area_s, round(area_s / sum(area_s) OVER (PARTITION BY device_id), 9) AS share FROM areas""")
def screen_share(spark, sf):
    layouts = panes(view(spark, sf, "observations")).select(
        "device_id", F.col("tick_ts").alias("ts"), F.lit(0).cast("long").alias("id"), "panes"
    )
    return R.screen_share(layouts, slice_s=5 * DAY).withColumn("share", F.round("share", 9))


@query("D12_daily_volume", "captures", oracle="""
SELECT device_id, CAST(ts AS DATE) AS day, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars,
 count(*) < 4 AND sum(length(text)) < 80 AS on_target FROM captures GROUP BY ALL""")
def daily_volume(spark, sf):
    return R.daily_volume(view(spark, sf, "captures", "device_id", "ts", "text"), 4, 80)


@query("D14_summary_coverage", "summaries", "known_sessions", oracle="""
SELECT k.id AS session_id, count(s.id) AS n_summaries, arg_max(s.summary, s.created_ts) AS latest_summary,
 arg_max(s.model, s.created_ts) AS latest_model
FROM known_sessions k LEFT JOIN summaries s ON s.session_id = k.id GROUP BY k.id""")
def coverage(spark, sf):
    return R.summary_coverage(view(spark, sf, "known_sessions"), view(spark, sf, "summaries"))


@query("D14_tokens_per_model", "summaries", oracle="""
SELECT model, count(*) AS n_summaries, CAST(sum(tokens) AS BIGINT) AS tokens FROM summaries GROUP BY model""")
def tokens(spark, sf):
    return R.tokens_per_model(view(spark, sf, "summaries", "model", "tokens"))


@query("G2_rolling_activity", "activity", oracle="""
WITH hours AS (
 SELECT bucket, duration, unnest(generate_series(
  date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS window_start
 FROM activity)
SELECT bucket, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n_events,
 round(sum(duration), 4) AS total_s FROM hours GROUP BY bucket, window_start""")
def rolling(spark, sf):
    found = rolling_activity(view(spark, sf, "activity", "bucket", "ts", "duration"), "6 hours", "1 hour")
    return found.withColumn("total_s", F.round("total_s", 4))
