"""Idle stretches, epochs and layout changes along a device's ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom import settings as S
from tickloom.operators.sequence import Order, segments, with_earlier
from tickloom.operators.windows import panes

TICK = Order("tick_ts", "tick_ts")


def idle_segments(
    ticks: DataFrame, timeout_s: float = S.IDLE_TIMEOUT_S, slice_s: float = S.SLICE_S
) -> DataFrame:
    """Ticks with ``is_idle``, ``starts_idle`` and ``epoch``.

    ``starts_idle`` marks the first tick of an idle stretch. ``epoch`` is the
    time of the latest idle tick so far (NULL before any): two active ticks
    belong to one epoch exactly if no idle tick lies between them.
    """
    rounded = F.round("idle_s", 1)
    is_idle = rounded >= F.lit(float(timeout_s))
    flagged = ticks.withColumn("idle_s", rounded).withColumn(
        "is_idle", F.coalesce(is_idle, F.lit(False))
    )
    looked = with_earlier(
        flagged, ["device_id"], TICK,
        previous={"_was_idle": F.col("is_idle")},
        latest={"epoch": F.when(F.col("is_idle"), F.col("tick_ts"))},
        slice_s=slice_s,
    )
    starts = F.col("is_idle") & ~F.coalesce("_was_idle", F.lit(False))
    return looked.withColumn("starts_idle", starts).drop("_was_idle")


def idle_markers(segmented: DataFrame) -> DataFrame:
    """One capture row per idle stretch, at its first tick."""
    return segmented.filter("starts_idle").select(
        "device_id",
        F.col("tick_ts").alias("ts"),
        F.lit(S.IDLE_APP).alias("app"),
        F.lit("").alias("title"),
        F.lit("").alias("text"),
        F.lit(None).cast("string").alias("url"),
        F.lit(-1).alias("pid"),
        F.lit(None).cast("long").alias("window_id"),
        "idle_s",
        F.lit(True).alias("idle"),
    )


def active_epochs(segmented: DataFrame) -> DataFrame:
    """Active ticks with their epoch, to join observations on."""
    return segmented.filter(~F.col("is_idle")).select("device_id", "tick_ts", "epoch")


def layout_changes(observations: DataFrame, slice_s: float = S.SLICE_S) -> DataFrame:
    """Ticks whose ordered windows differ from the previous tick that had any.

    Compares (window_id, app, title) front to back; bounds do not count.
    ``observations`` carry the ``epoch``; each epoch starts with a change.
    """
    shown = panes(observations, F.first("epoch", True).alias("epoch"))
    identity = F.transform(
        "panes", lambda p: F.struct(p["window_id"], p["app"], p["title"])
    )
    with_key = shown.withColumn("_layout", identity)
    looked = with_earlier(
        with_key, ["device_id"], TICK,
        previous={"_last_layout": F.col("_layout"), "_last_epoch": F.col("epoch")},
        slice_s=slice_s,
    )
    changed = ~F.col("_layout").eqNullSafe(F.col("_last_layout")) | ~F.col(
        "epoch"
    ).eqNullSafe(F.col("_last_epoch"))
    return looked.filter(changed).select(
        "device_id", F.col("tick_ts").alias("ts"), "panes"
    )


def idle_stretches(
    ticks: DataFrame, timeout_s: float = S.IDLE_TIMEOUT_S, slice_s: float = S.SLICE_S
) -> DataFrame:
    """Every idle stretch with its ``start_ts``, last idle tick ``end_ts`` and
    ``n`` ticks, and the first active tick after it, if there is one."""
    flagged = ticks.select(
        "device_id", "tick_ts",
        F.coalesce(F.round("idle_s", 1) >= F.lit(float(timeout_s)), F.lit(False)).alias("is_idle"),
    )
    cut = segments(
        flagged, ["device_id"], TICK, ["is_idle"],
        lambda before, here: before("is_idle") != here("is_idle"),
        slice_s=slice_s,
    )
    # Segments are few against ticks, yet a busy device may still have many:
    # the look ahead is a look back from the active segment that follows.
    back = with_earlier(
        cut.withColumn("_id", F.lit(0)), ["device_id"], Order("start_ts", "_id"),
        previous={
            "idle_start": F.col("start_ts"), "idle_end": F.col("end_ts"),
            "idle_ticks": F.col("n"), "_idle": F.col("head")["is_idle"],
        },
        slice_s=slice_s * 30,
    )
    return back.filter("_idle").select(
        "device_id", F.col("idle_start").alias("start_ts"), F.col("idle_end").alias("end_ts"),
        F.col("idle_ticks").alias("n"), F.col("start_ts").alias("return_ts"),
    )

