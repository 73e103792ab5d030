"""The whole capture loop over stored observations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from tickloom import settings as S
from tickloom.operators import capture as C, idle, windows as W
from tickloom.operators.dedup import dedup
from tickloom.operators.sequence import Order


class CaptureLoop:
    """Observations to kept captures, layout changes and idle markers.

    ``ticks`` has one row per device and tick; ``observations`` one per window
    seen, with its element already matched. Windows seen in idle ticks and in
    ticks without any element do not count. Each window of each device, in
    each stretch between idle times, is a sequence of its own.

    A part is planned when it is first asked for; only ``captures`` stores
    anything.
    """

    def __init__(
        self,
        ticks: DataFrame,
        observations: DataFrame,
        idle_timeout_s: float = S.IDLE_TIMEOUT_S,
        threshold: float = S.SIMILARITY_THRESHOLD,
        forced_snapshot_s: float = S.FORCED_SNAPSHOT_S,
        slice_s: float = S.SLICE_S,
        dedup_slice_s: float = S.RECURRENCE_SLICE_S,
    ) -> None:
        self._threshold, self._snapshot_s = threshold, forced_snapshot_s
        self._slice_s, self._dedup_slice_s = slice_s, dedup_slice_s
        self._segmented = idle.idle_segments(ticks, idle_timeout_s, slice_s)
        self._seen = W.filter_visible(observations)
        # Which ticks count is settled on rows of ticks; texts are masked and cut
        # where they are read, before they are shuffled.
        self._live = idle.active_epochs(self._segmented).join(
            W.matched_ticks(self._seen), ["device_id", "tick_ts"])

    @cached_property
    def captures(self) -> DataFrame:
        captured = C.capture(self._seen, keep=["id", "device_id", "tick_ts"]).join(
            self._live, ["device_id", "tick_ts"]
        ).withColumnRenamed("tick_ts", "ts")
        return dedup(
            captured, ["device_id", "window_id", "epoch"], Order("ts", "id"),
            self._threshold, self._snapshot_s, slice_s=self._dedup_slice_s,
        ).drop("epoch")

    @cached_property
    def layouts(self) -> DataFrame:
        shown = self._seen.select(
            "device_id", "tick_ts", "z", "window_id", "app", "pid", "title", "bounds"
        ).join(self._live, ["device_id", "tick_ts"])
        return idle.layout_changes(shown, self._slice_s)

    @cached_property
    def idle_markers(self) -> DataFrame:
        return idle.idle_markers(self._segmented)
