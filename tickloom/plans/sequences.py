"""Idle stretches, layouts, de-duplication, transitions."""

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.similarity import similarity_bound, text_similarity
from tickloom.operators import dedup as D, idle, sessions as R
from tickloom.operators.sequence import Order, with_earlier
from tickloom.plans.batch_loop import CaptureLoop
from tickloom.plans.captures import CAPTURED, VISIBLE
from tickloom.plans.registry import query
from tickloom.plans.views import dealt, view

# Events of one user are hours apart in the given data, so the thresholds are
# days and a time slice is a month.
DAY = 86_400
SNAPSHOT_S, SLICE_S = 10 * DAY, 20 * DAY

IDLE = """
WITH flagged AS (
 SELECT device_id, tick_ts, round(idle_s, 1) AS idle_s, round(idle_s, 1) >= 180 AS is_idle FROM ticks),
looked AS (
 SELECT *, is_idle AND NOT coalesce(lag(is_idle) OVER w, false) AS starts_idle,
  max(CASE WHEN is_idle THEN tick_ts END) OVER (w ROWS UNBOUNDED PRECEDING) AS epoch
 FROM flagged WINDOW w AS (PARTITION BY device_id ORDER BY tick_ts))
"""


@query("W4_idle_segments", "ticks", oracle=IDLE + """
SELECT device_id, tick_ts, idle_s, is_idle, starts_idle, epoch FROM looked""")
def idle_segments(spark, sf):
    return idle.idle_segments(view(spark, sf, "ticks"), slice_s=2 * DAY)


@query("W4_idle_markers", "ticks", oracle=IDLE + """
SELECT device_id, tick_ts AS ts, 'IDLE' AS app, '' AS title, '' AS text, CAST(NULL AS VARCHAR) AS url,
 -1 AS pid, CAST(NULL AS BIGINT) AS window_id, idle_s, true AS idle FROM looked WHERE starts_idle""")
def idle_markers(spark, sf):
    return idle.idle_markers(idle.idle_segments(view(spark, sf, "ticks"), slice_s=2 * DAY))


# Day ticks: a device is idle on a day with one long pause.
DAY_TICKS = """
WITH day_ticks AS (
 SELECT device_id, tick_ts, max(idle_s) >= 180 AS is_idle FROM observations GROUP BY device_id, tick_ts),
epochs AS (
 SELECT device_id, tick_ts, is_idle, max(CASE WHEN is_idle THEN tick_ts END)
  OVER (PARTITION BY device_id ORDER BY tick_ts ROWS UNBOUNDED PRECEDING) AS epoch FROM day_ticks),
"""
LAYOUTS = """
shown AS (
 SELECT o.device_id, o.tick_ts, any_value(e.epoch) AS epoch,
  string_agg(o.window_id || '/' || o.app || '/' || o.title, ';' ORDER BY o.z) AS layout
 FROM {source} o JOIN epochs e ON e.device_id = o.device_id AND e.tick_ts = o.tick_ts
 WHERE NOT e.is_idle GROUP BY o.device_id, o.tick_ts),
changes AS (
 SELECT device_id, tick_ts AS ts, layout FROM (
  SELECT *, lag(layout) OVER w AS l, lag(epoch) OVER w AS e FROM shown
  WINDOW w AS (PARTITION BY device_id ORDER BY tick_ts))
 WHERE layout IS DISTINCT FROM l OR epoch IS DISTINCT FROM e)
"""


def day_ticks(observations):
    return observations.groupBy("device_id", "tick_ts").agg(F.max("idle_s").alias("idle_s"))


def layout_text(layouts):
    """Layouts as text, to compare them with another engine's."""
    return layouts.select(
        "device_id", "ts",
        F.array_join(
            F.transform("panes", lambda p: F.concat_ws("/", p["window_id"], p["app"], p["title"])),
            ";",
        ).alias("layout"),
    )


@query("W5_layout_changes", "observations", oracle=DAY_TICKS + LAYOUTS.format(source="observations") + """
SELECT device_id, ts, layout FROM changes""")
def layout_changes(spark, sf):
    seen = view(spark, sf, "observations")
    epochs = idle.active_epochs(idle.idle_segments(day_ticks(seen), slice_s=3 * DAY))
    active = seen.join(epochs, ["device_id", "tick_ts"])
    return layout_text(idle.layout_changes(active, slice_s=3 * DAY))


@query("W6_transitions", "captures", oracle="""
SELECT id, device_id, ts, from_app, app AS to_app FROM (
 SELECT *, lag(app) OVER (PARTITION BY device_id ORDER BY ts, id) AS from_app FROM captures)
WHERE from_app <> app""")
def transitions(spark, sf):
    return R.transitions(view(spark, sf, "captures", "id", "device_id", "ts", "app"), slice_s=3 * DAY)


@query("D13_transition_flag", "captures", oracle="""
SELECT id, device_id, ts, app, coalesce(
 lag(app) OVER (PARTITION BY device_id ORDER BY ts, id) <> app, false) AS transition FROM captures""")
def transition_flag(spark, sf):
    rows = view(spark, sf, "captures", "id", "device_id", "ts", "app")
    return R.flag_transitions(rows, slice_s=3 * DAY)


def kept_sql(source: str, keys: list[str], snapshot_days: int, differs: str = "false") -> str:
    """Rules one to five as a recursion over the rows of a sequence.

    ``differs`` is rule six, over a row ``s`` and ``r.kid``, the id of the last kept one.
    """
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    keep = (
        "(s.app IS DISTINCT FROM r.kapp OR (coalesce(s.url, '') <> '' AND s.url IS DISTINCT FROM r.kurl)"
        " OR s.title IS DISTINCT FROM r.ktitle"
        f" OR s.ts - r.kts >= INTERVAL {snapshot_days} DAY OR {differs})"
    )
    return f"""
seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY ts, id) AS rn
 FROM {source}),
walk AS (
 SELECT {', '.join(keys)}, id, rn, true AS keep, app AS kapp, url AS kurl, title AS ktitle, ts AS kts,
  id AS kid
 FROM seq WHERE rn = 1
 UNION ALL
 SELECT {', '.join('s.' + k for k in keys)}, s.id, s.rn, {keep},
  CASE WHEN {keep} THEN s.app ELSE r.kapp END, CASE WHEN {keep} THEN s.url ELSE r.kurl END,
  CASE WHEN {keep} THEN s.title ELSE r.ktitle END, CASE WHEN {keep} THEN s.ts ELSE r.kts END,
  CASE WHEN {keep} THEN s.id ELSE r.kid END
 FROM walk r JOIN seq s ON {on} AND s.rn = r.rn + 1)"""


@query("W2_dedup", "repeats", oracle="WITH RECURSIVE " + kept_sql(
    "repeats_by_app", ["device_id", "gapp"], 10).replace(
    "repeats_by_app", "(SELECT *, app AS gapp FROM repeats)").strip() + """
SELECT q.id, q.device_id, q.ts, q.app, q.title, q.url FROM walk w JOIN repeats q ON q.id = w.id
WHERE w.keep""")
def dedup_rules(spark, sf):
    rows = view(spark, sf, "repeats", "id", "device_id", "ts", "app", "title", "url", "text")
    kept = D.dedup(rows, ["device_id", "app"], threshold=0, forced_snapshot_s=SNAPSHOT_S,
                   slice_s=SLICE_S)
    return kept.drop("text")


ACTIVE = """flagged AS (SELECT *, idle_s >= 180 AS is_idle FROM repeats),
spans AS (SELECT *, app AS gapp, max(CASE WHEN is_idle THEN ts END)
 OVER (PARTITION BY device_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS epoch FROM flagged),
active AS (SELECT * FROM spans WHERE NOT is_idle),"""


def in_epochs(rows: DataFrame, ticks: DataFrame) -> DataFrame:
    """The rows outside idle stretches, with the epoch they belong to. ``ticks`` are the
    same rows with nothing but what makes epochs, as these are read more than once."""
    ticks = ticks.select("id", "device_id", F.col("ts").alias("tick_ts"), "idle_s")
    epochs = idle.active_epochs(idle.idle_segments(ticks, slice_s=3 * DAY))
    # Several rows of one instant are one tick: a join on it must not multiply them.
    spans = epochs.groupBy("device_id", F.col("tick_ts").alias("ts")).agg(F.max("epoch").alias("epoch"))
    return rows.join(spans, ["device_id", "ts"])


def idle_times(spark, sf) -> DataFrame:
    """What ``in_epochs`` needs of the repeating rows."""
    return view(spark, sf, "repeats", "id", "device_id", "ts", "idle_s")


@query("W3_dedup_per_epoch", "repeats", oracle="WITH RECURSIVE " + ACTIVE + kept_sql(
    "active", ["device_id", "gapp", "epoch"], 10) + """
SELECT q.id, q.device_id, q.ts, q.app, q.title, q.url FROM walk w JOIN repeats q ON q.id = w.id
WHERE w.keep""")
def dedup_per_epoch(spark, sf):
    rows = view(spark, sf, "repeats", "id", "device_id", "ts", "app", "title", "url", "text")
    kept = D.dedup(in_epochs(rows, idle_times(spark, sf)), ["device_id", "app", "epoch"], threshold=0,
                   forced_snapshot_s=SNAPSHOT_S, slice_s=SLICE_S)
    return kept.select("id", "device_id", "ts", "app", "title", "url")


@query("W1_dedup_full_rule")
def dedup_full(spark, sf):
    """All rules, with text similarity, over the repeating sequences."""
    rows = view(spark, sf, "repeats", "id", "device_id", "ts", "app", "title", "url", "text")
    return D.dedup(rows, ["device_id", "app"], forced_snapshot_s=SNAPSHOT_S, slice_s=SLICE_S)


@query("W2_dedup_conversations")
def dedup_turns(spark, sf):
    """All rules over the real texts of conversations."""
    return D.dedup(view(spark, sf, "turns"))


@query("P8_similarity_bound", "turns", oracle="""
SELECT window_id, id, round(CASE WHEN la + lb = 0 THEN 1.0 ELSE 2.0 * least(la, lb) / (la + lb) END, 9) AS bound
FROM (SELECT window_id, id, least(length(text), 2000) AS la,
 least(length(coalesce(lag(text) OVER (PARTITION BY window_id ORDER BY ts, id), '')), 2000) AS lb FROM turns)""")
def bound(spark, sf):
    seen = with_earlier(view(spark, sf, "turns"), ["window_id"], Order(),
                        previous={"_before": F.col("text")})
    return seen.select(
        "window_id", "id",
        F.round(similarity_bound(F.col("text"), F.col("_before")), 9).alias("bound"),
    )


@query("P8_text_similarity")
def similarity(spark, sf):
    """Similarity of every turn to the turn before."""
    seen = with_earlier(view(spark, sf, "turns"), ["window_id"], Order(),
                        previous={"_before": F.col("text")})
    return seen.select(
        "window_id", "id", text_similarity(F.col("text"), F.col("_before")).alias("similarity")
    )


@query("A4_dedup_report", "repeats", oracle="WITH RECURSIVE " + kept_sql(
    "(SELECT *, 0 AS zero FROM repeats)", ["device_id"], 10).strip() + """,
marked AS (SELECT q.device_id, q.ts, q.id, q.app, w.keep FROM walk w JOIN repeats q ON q.id = w.id),
before AS (SELECT device_id, count(*) AS n_raw, count(*) FILTER (WHERE a <> app) AS transitions_raw
 FROM (SELECT *, lag(app) OVER (PARTITION BY device_id ORDER BY ts, id) AS a FROM marked) GROUP BY device_id),
after AS (SELECT device_id, count(*) AS n_kept, count(*) FILTER (WHERE a <> app) AS transitions_kept
 FROM (SELECT *, lag(app) OVER (PARTITION BY device_id ORDER BY ts, id) AS a FROM marked WHERE keep) GROUP BY device_id)
SELECT device_id, n_raw, n_kept, round(1 - n_kept / n_raw, 9) AS reduction, transitions_raw, transitions_kept
FROM before JOIN after USING (device_id)""")
def report(spark, sf):
    raw = view(spark, sf, "repeats", "id", "device_id", "ts", "app", "title", "url", "text")
    kept = D.dedup(raw, ["device_id"], threshold=0, forced_snapshot_s=SNAPSHOT_S, slice_s=SLICE_S)
    counted = D.dedup_report(raw, kept, ["device_id"], slice_s=5 * DAY)
    return counted.withColumn("reduction", F.round("reduction", 9))


LOOP_ROWS = "WITH RECURSIVE " + (DAY_TICKS + CAPTURED.strip().replace("WITH read AS", "read AS") + f""",
good AS (SELECT DISTINCT device_id, tick_ts FROM observations WHERE {VISIBLE} AND matched),
active AS (
 SELECT c.*, c.tick_ts AS ts, e.epoch FROM captured c
 JOIN (SELECT id FROM observations WHERE {VISIBLE}) v ON v.id = c.id
 JOIN good g ON g.device_id = c.device_id AND g.tick_ts = c.tick_ts
 JOIN epochs e ON e.device_id = c.device_id AND e.tick_ts = c.tick_ts AND NOT e.is_idle),
""").strip()[len("WITH "):]
LOOP_KEYS = ["device_id", "window_id", "epoch"]
LOOP = LOOP_ROWS + kept_sql("active", LOOP_KEYS, 10)


@query("L1_capture_loop", "observations", oracle=LOOP + """
SELECT a.id, a.device_id, a.ts, a.app, a.title, a.text, a.url, a.filtered
FROM walk w JOIN active a ON a.id = w.id WHERE w.keep""")
def loop_captures(spark, sf):
    seen = dealt(view(spark, sf, "observations"))
    result = CaptureLoop(day_ticks(seen), seen, threshold=0, forced_snapshot_s=SNAPSHOT_S,
                         slice_s=SLICE_S, dedup_slice_s=SLICE_S)
    return result.captures.select(
        "id", "device_id", "ts", "app", "title", "text", "url", "filtered"
    )


@query("L1_capture_loop_layouts", "observations", oracle=DAY_TICKS + f"""
visible AS (SELECT * FROM observations WHERE {VISIBLE}),
good AS (SELECT v.* FROM visible v WHERE EXISTS (SELECT 1 FROM visible o
 WHERE o.device_id = v.device_id AND o.tick_ts = v.tick_ts AND o.matched)),
""" + LAYOUTS.format(source="good") + "SELECT device_id, ts, layout FROM changes")
def loop_layouts(spark, sf):
    seen = view(spark, sf, "observations")
    return layout_text(CaptureLoop(day_ticks(seen), seen, slice_s=3 * DAY).layouts)
