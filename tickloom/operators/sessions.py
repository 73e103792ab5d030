"""Sessions, switches and attention reports over captures and events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame, functions as F

from tickloom import settings as S
from tickloom.functions.times import seconds_between
from tickloom.operators.last_kept import keep_against_last
from tickloom.operators.lists import only_listed
from tickloom.operators.sequence import (
    Order, asof_join, segments, trailing_window, with_earlier,
)

DEVICE = ["device_id"]


def transitions(captures: DataFrame, order: Order = Order(), slice_s: float = S.SLICE_S) -> DataFrame:
    """Changes of app along a device: ``from_app``, ``to_app`` and when."""
    seen = with_earlier(
        captures.select("device_id", order.ts, order.tie, "app"), DEVICE, order,
        previous={"from_app": F.col("app"), "_there": F.lit(True)}, slice_s=slice_s,
    )
    return seen.filter(
        F.col("_there").isNotNull() & ~F.col("from_app").eqNullSafe(F.col("app"))
    ).select("device_id", order.ts, order.tie, "from_app", F.col("app").alias("to_app"))


def flag_transitions(captures: DataFrame, order: Order = Order(), slice_s: float = S.SLICE_S) -> DataFrame:
    """Captures with ``transition``: the app differs from the capture before."""
    seen = with_earlier(
        captures.drop("transition"), DEVICE, order,
        previous={"_app": F.col("app"), "_there": F.lit(True)}, slice_s=slice_s,
    )
    return seen.withColumn(
        "transition",
        F.col("_there").isNotNull() & ~F.col("_app").eqNullSafe(F.col("app")),
    ).drop("_app", "_there")


def sessions(
    captures: DataFrame,
    gap_s: float = S.SESSION_GAP_S,
    order: Order = Order(),
    slice_s: float = S.SLICE_S,
) -> DataFrame:
    """Stretches of one app and title, continued over pauses below ``gap_s``."""
    keys = ["device_id", "app", "title"]
    found = segments(
        captures.select(*keys, order.ts, order.tie, "url"), keys, order, ["url"],
        lambda before, here: seconds_between(before(order.ts), here(order.ts)) >= gap_s,
        slice_s=slice_s,
    )
    return found.select(
        *keys, "start_ts", "end_ts", F.col("head")["url"].alias("url"),
        F.col("n").alias("capture_count"),
        seconds_between(F.col("start_ts"), F.col("end_ts")).alias("duration_s"),
    )


def app_runs(captures: DataFrame, order: Order = Order(), slice_s: float = S.SLICE_S) -> DataFrame:
    """Unbroken stretches of one app along a device."""
    runs = segments(
        captures.select("device_id", order.ts, order.tie, "app"), DEVICE, order, ["app"],
        lambda before, here: ~before("app").eqNullSafe(here("app")), slice_s=slice_s,
    )
    return runs.select(
        "device_id", F.col("head")["app"].alias("app"), "start_ts", "end_ts", "n",
        seconds_between(F.col("start_ts"), F.col("end_ts")).alias("duration_s"),
    )


def app_totals(events: DataFrame) -> DataFrame:
    """Time per device, day and app."""
    return events.groupBy("device_id", F.to_date("ts").alias("day"), "app").agg(
        F.sum("duration").alias("total_s"), F.count(F.lit(1)).alias("n_events")
    )


def switch_bursts(
    captures: DataFrame, at_least: int = 8, within_s: int = 300,
    order: Order = Order(), slice_s: float = S.SLICE_S,
) -> DataFrame:
    """Switches that complete ``at_least`` switches within ``within_s``."""
    rows, window = trailing_window(
        transitions(captures, order, slice_s), DEVICE, order.ts, within_s, slice_s
    )
    counted = rows.withColumn("n_switches", F.count(F.lit(1)).over(window))
    return counted.filter(~F.col("_carry") & (F.col("n_switches") >= at_least)).select(
        "device_id", order.ts, order.tie, "n_switches"
    )


def distraction_dwell(
    found_sessions: DataFrame, apps: Sequence[str] | DataFrame = S.DISTRACTION_APPS, over_s: float = 600
) -> DataFrame:
    """Sessions in one of the listed apps that last longer than ``over_s``. A long list
    comes as a table of one column."""
    long = found_sessions.filter(F.col("duration_s") > over_s)
    if isinstance(apps, DataFrame):
        return only_listed(long, F.col("app"), apps)
    return long.filter(F.col("app").isin(list(apps)))


def focus_ends(
    captures: DataFrame, over_s: float = 1800, order: Order = Order(), slice_s: float = S.SLICE_S,
    run_slice_s: float | None = None,
) -> DataFrame:
    """Runs of one app longer than ``over_s`` that end with a switch: the app
    left, the app switched to, and when."""
    runs = app_runs(captures, order, slice_s)
    # A run that has a successor is seen from the successor.
    seen = with_earlier(
        runs, DEVICE, Order("start_ts", "n"),
        previous={"focus_app": F.col("app"), "focus_s": F.col("duration_s")},
        slice_s=run_slice_s or slice_s,
    )
    return seen.filter(F.col("focus_s") > over_s).select(
        "device_id", "focus_app", F.col("app").alias("next_app"),
        F.col("start_ts").alias("switch_ts"), "focus_s",
    )


def returns_from_idle(stretches: DataFrame, over_s: float = 300) -> DataFrame:
    """Returns after an absence longer than ``over_s``."""
    away = seconds_between(F.col("start_ts"), F.col("return_ts"))
    return stretches.withColumn("away_s", away).filter(F.col("away_s") > over_s)


@dataclass
class CooldownRule:
    """At most one trigger per cool-down, a longer one after a dismissal."""

    cooldown_s: float = S.COOLDOWN_S
    dismissed_s: float = S.COOLDOWN_DISMISSED_S
    columns: ClassVar[list[str]] = ["dismissed"]
    cuts: ClassVar[list[str]] = []

    @property
    def horizon_s(self) -> float:
        return max(self.cooldown_s, self.dismissed_s)

    def horizon_after(self, kept: tuple) -> float:
        return self.dismissed_s if kept[0] else self.cooldown_s

    def differs(self, new: tuple, kept: tuple) -> bool:
        return False


def cool_down(
    triggers: DataFrame, cooldown_s: float = S.COOLDOWN_S,
    dismissed_s: float = S.COOLDOWN_DISMISSED_S, order: Order = Order(),
    slice_s: float = S.RECURRENCE_SLICE_S,
) -> DataFrame:
    """The triggers that pass the cool-down after the last one that passed."""
    return keep_against_last(
        triggers, DEVICE, order, CooldownRule(cooldown_s, dismissed_s), slice_s
    )


def screen_at(
    moments: DataFrame, layouts: DataFrame, captures: DataFrame, slice_s: float = S.SLICE_S
) -> DataFrame:
    """What was on screen at each moment: the latest layout not after it, and
    for each of its panes the latest capture not after it.

    ``moments`` has device_id, moment_id and at_ts.
    """
    placed = asof_join(
        moments.select("device_id", "moment_id", "at_ts"),
        layouts.select("device_id", F.col("ts").alias("layout_ts"), "id",
                       F.transform("panes", lambda p: p["window_id"]).alias("panes")),
        DEVICE, "at_ts", "layout_ts", "id", ["layout_ts", "panes"], slice_s,
    )
    shown = placed.select(
        "device_id", "moment_id", "at_ts", "layout_ts",
        F.posexplode("panes").alias("z", "_pane"),
    ).select(
        "device_id", "moment_id", "at_ts", "layout_ts", "z",
        F.col("_pane").alias("window_id"),
    )
    # The second search carries ids; texts meet only the captures it found.
    found = asof_join(
        shown,
        captures.select(
            "device_id", "window_id", F.col("ts").alias("capture_ts"), "id",
            F.col("id").alias("capture_id"),
        ),
        ["device_id", "window_id"], "at_ts", "capture_ts", "id",
        ["capture_ts", "capture_id"], slice_s,
    )
    texts = captures.select(F.col("id").alias("capture_id"), "app", "title", "text")
    return found.join(texts, "capture_id", "left").select(
        *shown.columns, "capture_ts", "app", "title", "text")


def screen_share(layouts: DataFrame, slice_s: float = S.SLICE_S) -> DataFrame:
    """Share of screen area and time per device and app: each layout counts
    with the areas of its panes until the next layout of the device."""
    # The time a layout lasted is known at the next one.
    seen = with_earlier(
        layouts.select("device_id", "ts", "id", "panes"), DEVICE, Order(),
        previous={"shown_panes": F.col("panes"), "shown_ts": F.col("ts")}, slice_s=slice_s,
    )
    shown = seen.filter(F.col("shown_ts").isNotNull()).select(
        "device_id",
        seconds_between(F.col("shown_ts"), F.col("ts")).alias("_s"),
        F.explode("shown_panes").alias("_p"),
    )
    area = F.col("_p")["bounds"]["Width"].cast("double") * F.col("_p")["bounds"]["Height"]
    per_app = shown.groupBy("device_id", F.col("_p")["app"].alias("app")).agg(
        F.sum(area * F.col("_s")).alias("area_s")
    )
    whole = per_app.groupBy("device_id").agg(F.sum("area_s").alias("_all"))
    return per_app.join(whole, "device_id").select(
        "device_id", "app", "area_s",
        F.when(F.col("_all") > 0, F.col("area_s") / F.col("_all")).alias("share"),
    )


def daily_volume(
    captures: DataFrame, max_rows: int = 200, max_chars: int = 1_000_000
) -> DataFrame:
    """Rows and characters per device and day, and whether both are below the
    targets."""
    daily = captures.groupBy("device_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"),
    )
    return daily.withColumn(
        "on_target", (F.col("n_rows") < max_rows) & (F.col("n_chars") < max_chars)
    )


def summary_coverage(sessions_df: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every session with its latest summary, if it has one."""
    latest = summaries.groupBy("session_id").agg(
        F.max_by(F.struct("summary", "model"), F.struct("created_ts", "id")).alias("_last"),
        F.count(F.lit(1)).alias("n_summaries"),
    )
    return sessions_df.select(F.col("id").alias("session_id")).join(
        latest, "session_id", "left"
    ).select(
        "session_id",
        F.coalesce("n_summaries", F.lit(0)).alias("n_summaries"),
        F.col("_last")["summary"].alias("latest_summary"),
        F.col("_last")["model"].alias("latest_model"),
    )


def tokens_per_model(summaries: DataFrame) -> DataFrame:
    """Number of summaries and tokens spent per model."""
    return summaries.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_summaries"), F.sum("tokens").alias("tokens")
    )
