"""The similarity rule under SQL, on texts whose similarity SQL can state.

A text is a number of characters of one fixed sequence, all different, and then
a number of characters of an alphabet of its own. Two such texts have their
common beginning in common and nothing else, so the ratio of matching blocks is
exactly twice the shorter beginning over both lengths.
"""

from pyspark.sql import Column, functions as F

from tickloom import settings as S
from tickloom.functions.similarity import text_similarity
from tickloom.operators import dedup as D
from tickloom.operators.sequence import Order, with_earlier
from tickloom.plans.batch_loop import CaptureLoop
from tickloom.plans.registry import query
from tickloom.plans.sequences import (
    ACTIVE, DAY, LOOP_KEYS, LOOP_ROWS, SLICE_S, SNAPSHOT_S, day_ticks, idle_times, in_epochs, kept_sql,
)
from tickloom.plans.streams import capture_stream
from tickloom.plans.views import dealt, view

# Characters of the beginning and of the tails; no tail shares a character with
# another one or with the beginning.
BEGINNING = 60
_FIRST, _TAILS, _ALPHABET = 0x4E00, 0x5000, 20

# Of row ``id``: 40 to 60 characters of the beginning, and 0 to 19 of one of 97 alphabets.
HEAD_N = "40 + (id * 7) % 21"
TAIL_N = "(id * 11) % 20"


def graded_text() -> Column:
    begin = "".join(chr(_FIRST + i) for i in range(BEGINNING))
    tails = F.array(*(
        F.lit("".join(chr(_TAILS + _ALPHABET * a + i) for i in range(_ALPHABET))) for a in range(97)))
    tail = F.element_at(tails, (F.col("id") % 97 + 1).cast("int"))
    return F.concat(F.left(F.lit(begin), F.expr(HEAD_N).cast("int")), F.left(tail, F.expr(TAIL_N).cast("int")))


def ratio_sql(a: str, b: str) -> str:
    """Similarity of the texts of rows ``a`` and ``b``; equal alphabets and lengths share their tails too."""
    def n(text: str, row: str) -> str:
        return f"({text.replace('id', row + '.id')})"

    heads, tails = (f"least({n(x, a)}, {n(x, b)})" for x in (HEAD_N, TAIL_N))
    # A common tail follows the beginnings whatever their length.
    common = f"({heads} + CASE WHEN {a}.id % 97 = {b}.id % 97 THEN {tails} ELSE 0 END)"
    return f"(2.0 * {common} / ({n(HEAD_N, a)} + {n(TAIL_N, a)} + {n(HEAD_N, b)} + {n(TAIL_N, b)}))"


def graded(spark, sf, *columns):
    return view(spark, sf, "repeats", "id", "device_id", "ts", "app", "title", "url", *columns).withColumn(
        "text", graded_text())


#: Rule six, of a row ``s`` against the last kept one.
DIFFERS = f"{ratio_sql('s', 'r').replace('r.id', 'r.kid')} < 0.85"


@query("P8_graded_similarity", "repeats", oracle=f"""
WITH pairs AS (SELECT id, lag(id) OVER (PARTITION BY device_id, app ORDER BY ts, id) AS before FROM repeats),
a AS (SELECT id, before FROM pairs WHERE before IS NOT NULL)
SELECT a.id, round({ratio_sql('a', 'b')}, 9) AS similarity FROM a JOIN (SELECT id FROM repeats) b ON b.id = a.before""")
def graded_similarity(spark, sf):
    seen = with_earlier(graded(spark, sf), ["device_id", "app"], Order(), previous={"_before": F.col("text")},
                        slice_s=SLICE_S)
    return seen.filter(F.col("_before").isNotNull()).select(
        "id", F.round(text_similarity(F.col("text"), F.col("_before")), 9).alias("similarity"))


@query("W1_graded_dedup", "repeats", oracle="WITH RECURSIVE " + kept_sql(
    "(SELECT *, app AS gapp FROM repeats)", ["device_id", "gapp"], 10, DIFFERS).strip() + """
SELECT id FROM walk WHERE keep""")
def graded_dedup(spark, sf):
    kept = D.dedup(graded(spark, sf), ["device_id", "app"], forced_snapshot_s=SNAPSHOT_S, slice_s=SLICE_S)
    return kept.select("id")


@query("W3_graded_per_epoch", "repeats", oracle="WITH RECURSIVE " + ACTIVE + kept_sql(
    "active", ["device_id", "gapp", "epoch"], 10, DIFFERS) + """
SELECT id, device_id, ts FROM walk JOIN (SELECT id, ts FROM repeats) USING (id) WHERE keep""")
def graded_per_epoch(spark, sf):
    kept = D.dedup(in_epochs(graded(spark, sf), idle_times(spark, sf)), ["device_id", "app", "epoch"],
                   forced_snapshot_s=SNAPSHOT_S, slice_s=SLICE_S)
    return kept.select("id", "device_id", "ts")


@query("A4_graded_report", "repeats", oracle="WITH RECURSIVE " + kept_sql(
    "repeats", ["device_id"], 10, DIFFERS).strip() + """,
marked AS (SELECT q.device_id, q.ts, q.id, q.app, w.keep FROM walk w JOIN repeats q ON q.id = w.id),
steps AS (
 SELECT device_id, keep, false AS kept_only, app <> lag(app) OVER (PARTITION BY device_id ORDER BY ts, id) AS moved
 FROM marked UNION ALL
 SELECT device_id, keep, true, app <> lag(app) OVER (PARTITION BY device_id ORDER BY ts, id) FROM marked WHERE keep)
SELECT device_id, count(*) FILTER (WHERE NOT kept_only) AS n_raw, count(*) FILTER (WHERE kept_only) AS n_kept,
 round(1 - count(*) FILTER (WHERE kept_only) / count(*) FILTER (WHERE NOT kept_only), 9) AS reduction,
 count(*) FILTER (WHERE moved AND NOT kept_only) AS transitions_raw,
 count(*) FILTER (WHERE moved AND kept_only) AS transitions_kept
FROM steps GROUP BY device_id""")
def graded_report(spark, sf):
    raw = graded(spark, sf)
    kept = D.dedup(raw, ["device_id"], forced_snapshot_s=SNAPSHOT_S, slice_s=SLICE_S)
    counted = D.dedup_report(raw, kept, ["device_id"], slice_s=5 * DAY)
    return counted.withColumn("reduction", F.round("reduction", 9))


# A capture without text is a masked one, or one without an element.
GRADED_LOOP = LOOP_ROWS.replace("WITH RECURSIVE ", f"""WITH RECURSIVE graded AS (
 SELECT * REPLACE ([repeat('x', {HEAD_N} + {TAIL_N})] AS texts) FROM observations),
""").replace("'' END AS t FROM observations", "'' END AS t FROM graded") + kept_sql(
    "active", LOOP_KEYS, 10, f"(s.text <> '' AND {DIFFERS})") + """
SELECT a.id, a.device_id, a.ts, a.app, a.title, length(a.text) AS n_chars, a.filtered
FROM walk w JOIN active a ON a.id = w.id WHERE w.keep"""


def graded_windows(seen):
    """Observations whose only text is the graded one."""
    return seen.withColumn("texts", F.array(graded_text()))


def loop_columns(captures):
    return captures.select(
        "id", "device_id", "ts", "app", "title", F.length("text").alias("n_chars"), "filtered")


@query("L1_graded_loop", "observations", oracle=GRADED_LOOP)
def graded_loop(spark, sf):
    seen = graded_windows(dealt(view(spark, sf, "observations")))
    return loop_columns(CaptureLoop(
        day_ticks(seen), seen, forced_snapshot_s=SNAPSHOT_S, slice_s=SLICE_S, dedup_slice_s=SLICE_S).captures)


@query("G1_graded_stream", "observations", oracle=GRADED_LOOP)
def graded_stream(spark, sf):
    out = capture_stream(spark, sf, threshold=S.SIMILARITY_THRESHOLD, prepare=graded_windows)
    return loop_columns(out.filter(F.col("kind") == "capture"))
