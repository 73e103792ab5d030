"""The capture loop over streams of ticks and window observations.

Gives the rows of ``plans.batch_loop.CaptureLoop`` with three stateful operators:

1. by device, over narrow rows (what is on screen, no texts): idle markers, layouts, and
   for every active tick the number of its epoch, the stretch between two idle ones;
2. a join of ticks and captures on (device, instant);
3. by (device, window), epoch after epoch: which captures are kept.

So the captures of a device, which are nearly all the bytes and all the comparing,
spread over its instants and then over its windows; only the narrow rows of one device are
handled by one task.

Every use of state is a round trip between processes. So 1 and 3 group by buckets of devices
and of windows: a micro-batch costs some round trips for each bucket, however many keys it
has, and with fewer keys than ``buckets`` as many as there are keys.

Rows are held until the watermark has passed them and are then taken in time order, so
results come one watermark delay after the event. Rows later than that are dropped by the
engine. How many, is data: every input row counts as *seen* and every row that the first
operator is given as *taken*, and ``start_loop`` writes the difference for each device and
micro-batch to the table ``late``.

Narrow rows wait in the state by time slot. A call reads and deletes the slots that the
watermark has reached, one after another, and leaves the others alone; what a task holds is
one slot of one bucket of devices, and then what a micro-batch releases of one bucket of
windows: take more ``buckets`` if there are very many. What is remembered of a window counts
until a snapshot is due anyway. ``start_loop`` takes its source as
it is given: limit it there (``maxFilesPerTrigger``), so that a backfill comes in many
micro-batches.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom import settings as S
from tickloom.operators import capture as C, windows as W
from tickloom.operators.dedup import CaptureRule
from tickloom.schemas import flat

# What the loop needs to know of a tick (z NULL) or of one window in it.
INPUT = flat(
    "device_id long, ts timestamp, id long, z long, window_id long, pane_app string,"
    "pane_title string, pane string, matched boolean, recorded boolean, app string,"
    "title string, text string, url string, pid int, idle_s double, filtered string"
)
OUTPUT = flat(
    "kind string, device_id long, ts timestamp, id long, app string, title string, text string,"
    "url string, pid int, window_id long, idle_s double, idle boolean, filtered string,"
    "panes string, n long"
)
#: Kinds of rows: what the loop finds, and what is counted to find late rows.
FOUND, COUNTED = ("capture", "layout", "idle"), ("seen", "taken")

_SEEN = ["z", "window_id", "pane_app", "pane_title", "pane", "matched", "idle_s"]
_TICKS = flat("kind string, device_id long, ts timestamp, epoch long, idle_s double, panes string, n long")
_CAPTURED = ["id", "z", "window_id", "app", "title", "text", "url", "pid", "idle_s", "filtered"]
#: Buckets of devices, and of windows.
BUCKETS = 1024
# Rows wait as JSON, up to so many of one slot and input batch in one entry.
_ENTRY = 10_000
_SLOT = flat("slot long, part long")
_WAITING = flat("rows string")
# JSON: (device, (is idle, layout, epoch)) of all devices, and the number of parts so far.
_DEVICES = flat("devices string, parts long")
# JSON: (device, window, known), epoch, micros, app, title, url, text of all windows.
_LAST_KEPT = flat("windows string")
_ZERO = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def loop_rows(ticks: DataFrame, observations: DataFrame, **privacy) -> DataFrame:
    """Ticks and visible windows in the one shape that the loop takes. The
    privacy layers run here, before anything is kept in state."""
    visible = W.filter_visible(observations).withColumn("ts", F.col("tick_ts"))
    paned = visible.withColumns({
        "pane_app": F.col("app"),
        "pane_title": F.col("title"),
        "pane": F.to_json(
            F.struct("window_id", "app", "pid", "title", "bounds"),
            {"ignoreNullFields": "false"},
        ),
    })
    seen = C.capture(
        paned, only_recorded=False,
        keep=["device_id", "ts", "id", "z", "pane_app", "pane_title", "pane", "matched"],
        **privacy,
    )
    beats = ticks.select(
        "device_id", F.col("tick_ts").alias("ts"), F.round("idle_s", 1).alias("idle_s")
    )
    return beats.unionByName(seen, allowMissingColumns=True).select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in INPUT.fields)
    )


def _instant(micros: int) -> dt.datetime:
    return _ZERO + dt.timedelta(microseconds=micros)


def _row(names: list[str], **values) -> Row:
    return Row(**{n: values.get(n) for n in names})


def _bucket(buckets: int, *of: str | Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(buckets)).alias("bucket")


class Epochs(StatefulProcessor):
    """State of a bucket of devices: idle or not, and the layout last seen. Rows wait until
    the watermark has passed them."""

    columns = ["device_id", *_SEEN]

    def __init__(self, idle_timeout_s: float, slot_s: float) -> None:
        self.idle_timeout_s, self.slot_us = idle_timeout_s, int(slot_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", _SLOT, _WAITING)
        self.state = handle.getValueState("devices", _DEVICES)

    def close(self) -> None:
        pass

    def hold(self, rows: Iterator[Row]) -> dict[int, int]:
        """Put rows to the others; returns their number by device."""
        devices, part = self.state.get() or ("[]", 0)
        slots: dict[int, list] = {}
        n: dict[int, int] = {}
        first = None
        for row in rows:
            m, device = row["micros"], row["device_id"]
            waiting = slots.setdefault(m // self.slot_us, [])
            waiting.append([m, *(row[c] for c in self.columns)])
            n[device] = n.get(device, 0) + 1
            first = m if first is None else min(first, m)
            if len(waiting) == _ENTRY:
                self.held.updateValue((m // self.slot_us, part), (json.dumps(waiting),))
                del slots[m // self.slot_us]
                part += 1
        for slot, waiting in slots.items():
            self.held.updateValue((slot, part), (json.dumps(waiting),))
        if n:
            self.state.update((devices, part + 1))
            self.wake_at(first)
        return n

    def due(self, watermark: int) -> Iterator[list[dict]]:
        """Rows up to the watermark, slot by slot; wakes again for the first of the others."""
        due: dict[int, list[int]] = {}
        later = None  # the earliest instant that may still hold a row
        for slot, part in self.held.keys():
            start = slot * self.slot_us
            if start <= watermark:
                due.setdefault(slot, []).append(part)
            else:
                later = start if later is None else min(later, start)
        for slot in sorted(due):
            rows = [row for part in due[slot] for row in json.loads(self.held.getValue((slot, part))[0])]
            waiting = [row for row in rows if row[0] > watermark]
            for part in due[slot]:
                self.held.removeKey((slot, part))
            if waiting:
                for n, part in zip(range(0, len(waiting), _ENTRY), due[slot]):
                    self.held.updateValue((slot, part), (json.dumps(waiting[n:n + _ENTRY]),))
                start = min(row[0] for row in waiting)
                later = start if later is None else min(later, start)
            ready = [dict(zip(["micros", *self.columns], row)) for row in rows if row[0] <= watermark]
            if ready:
                yield ready
        if later is not None:
            self.wake_at(later)

    def wake_at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.hold(rows)
        if n:
            # Stands just after the watermark, where no row is late.
            now = _instant(timerValues.getCurrentWatermarkInMs() * 1000 + 1)
            for device, taken in n.items():
                yield _row(_TICKS.names, kind="taken", device_id=device, ts=now, n=taken)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, parts = self.state.get()
        devices = before = None
        for rows in self.due(timerValues.getCurrentWatermarkInMs() * 1000):
            if devices is None:
                devices = {device: tuple(state) for device, state in json.loads(known)}
                before = dict(devices)
            by_device: dict[int, list[dict]] = {}
            for row in rows:
                by_device.setdefault(row["device_id"], []).append(row)
            for device, its in by_device.items():
                for found in self._play(device, its, devices):
                    yield _row(_TICKS.names, **found)
        if devices != before:
            self.state.update((json.dumps(list(devices.items())), parts))

    def _play(self, device_id: int, rows: list[dict], devices: dict[int, tuple]) -> Iterator[dict]:
        """Go through complete ticks in order."""
        ticks: dict[int, list[dict]] = {}
        for row in rows:
            ticks.setdefault(row["micros"], []).append(row)
        is_idle, layout, epoch = devices.get(device_id, (False, None, 0))
        for micros in sorted(ticks):
            windows = sorted(
                (r for r in ticks[micros] if r["z"] is not None), key=lambda r: r["z"]
            )
            idle_s = max((r["idle_s"] for r in ticks[micros] if r["z"] is None and r["idle_s"] is not None),
                         default=max((r["idle_s"] or 0.0 for r in windows), default=0.0))
            base = {"device_id": device_id, "ts": _instant(micros)}
            if idle_s >= self.idle_timeout_s:
                if not is_idle:
                    yield {**base, "kind": "idle", "idle_s": idle_s}
                is_idle = True
                continue
            if is_idle:
                is_idle, layout, epoch = False, None, epoch + 1
            if not any(r["matched"] for r in windows):
                continue
            now = json.dumps([[r["window_id"], r["pane_app"], r["pane_title"]] for r in windows])
            if now != layout:
                layout = now
                yield {**base, "kind": "layout", "panes": "[" + ",".join(r["pane"] for r in windows) + "]"}
            yield {**base, "kind": "tick", "epoch": epoch}
        devices[device_id] = (is_idle, layout, epoch)


class Kept(StatefulProcessor):
    """State of a bucket of windows: the last kept capture of each. Other rows pass through.

    Ticks come once the watermark has passed them and meet their captures at once, so a
    micro-batch brings all rows of a window up to the watermark, and none before those of
    the last one. An epoch begins without a last kept capture, and none comes back.
    """

    def __init__(self, rule: CaptureRule, max_compare: int) -> None:
        self.rule, self.max_compare = rule, max_compare

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # While there is a value, a timer is set.
        self.kept = handle.getValueState("kept", _LAST_KEPT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        captures: dict[tuple, list] = {}
        for row in rows:
            if row["kind"] == "tick":
                captures.setdefault((row["device_id"], row["window"], row["known"]), []).append(row)
            elif row["kind"] == "idle":
                yield _row(OUTPUT.names, kind="idle", device_id=row["device_id"], ts=_instant(row["micros"]),
                           app=S.IDLE_APP, title="", text="", pid=-1, idle_s=row["idle_s"], idle=True)
            else:
                yield _row(OUTPUT.names, ts=_instant(row["micros"]),
                           **{c: row[c] for c in ("kind", "device_id", "panes", "n")})
        if not captures:
            return
        stored = self._stored()
        windows = dict(stored)
        for window, its in captures.items():
            last_epoch, last = windows.get(window, (None, None))
            for row in sorted(its, key=lambda r: (r["epoch"], r["micros"], r["z"])):
                if row["epoch"] != last_epoch:
                    last_epoch, last = row["epoch"], None
                micros = row["micros"]
                content = (row["app"], row["title"], row["url"], (row["text"] or "")[:self.max_compare])
                if last is None or self._keeps(micros, content, last):
                    last = (micros, *content)
                    yield _row(OUTPUT.names, kind="capture", device_id=window[0], ts=_instant(micros), idle=False,
                               **{c: row[c] for c in _CAPTURED if c != "z"})
            windows[window] = (last_epoch, last)
        if windows != stored:
            self._store(windows, timerValues, bool(stored))

    def _stored(self) -> dict[tuple, tuple]:
        """Window: (epoch, its last kept capture)."""
        state = self.kept.get()
        return {tuple(w): (epoch, tuple(last)) for w, epoch, last in json.loads(state[0])} if state else {}

    def _store(self, windows: dict[tuple, tuple], timerValues, timed: bool) -> None:
        """Remember what can still matter."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = [(w, epoch, last) for w, (epoch, last) in windows.items() if self._due(last) > now]
        if left or timed:
            self.kept.update((json.dumps(left),))
        if left and not timed:
            self._wake(left)

    def _due(self, last: tuple) -> int:
        """From then on the next capture is kept whatever came before it."""
        return last[0] + int(self.rule.horizon_after(last[1:]) * 1_000_000)

    def _wake(self, left: list[tuple]) -> None:
        """For the last one; until then others go as the bucket is written."""
        self.handle.registerTimer(-(-max(self._due(last) for _, _, last in left) // 1000))

    def _keeps(self, micros: int, content: tuple, last: tuple) -> bool:
        return micros >= self._due(last) or self.rule.differs(content, last[1:])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = [(w, epoch, last) for w, (epoch, last) in self._stored().items() if self._due(last) > now]
        if left:
            self.kept.update((json.dumps(left),))
            self._wake(left)
        else:
            self.kept.clear()
        return iter(())


def run_stream(
    rows: DataFrame,
    late: str = "1 minute",
    idle_timeout_s: float = S.IDLE_TIMEOUT_S,
    threshold: float = S.SIMILARITY_THRESHOLD,
    forced_snapshot_s: float = S.FORCED_SNAPSHOT_S,
    max_compare: int = S.MAX_TEXT_COMPARE,
    slot_s: float = 600,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Captures, layouts and idle markers of a stream of ``loop_rows``, told apart by
    ``kind``, with rows that count what was seen and taken. ``slot_s``: time that waiting
    rows of one state entry span; ``buckets``: of devices and of windows. Needs the RocksDB
    state store."""
    marked = rows.withWatermark("ts", late)
    micros = F.unix_micros("ts").alias("micros")
    ticks = marked.select(_bucket(buckets, "device_id"), "device_id", "ts", micros, *_SEEN).groupBy("bucket").transformWithState(
        statefulProcessor=Epochs(idle_timeout_s, slot_s), outputStructType=_TICKS, outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="ts",
    )
    captured = marked.where("recorded AND z IS NOT NULL").select(
        F.col("device_id").alias("c_device"), F.col("ts").alias("c_ts"),
        F.struct(*_CAPTURED).alias("capture"))
    met = ticks.join(
        captured, (F.col("kind") == "tick") & (F.col("device_id") == F.col("c_device")) & (F.col("ts") == F.col("c_ts")),
        "left_outer").where("kind <> 'tick' OR capture IS NOT NULL")
    window = F.col("capture.window_id")  # NULL and 0 are different windows.
    keyed = met.select(
        "kind", "device_id", "ts", micros, "panes", "n", F.coalesce("capture.idle_s", "idle_s").alias("idle_s"),
        *(F.col(f"capture.{c}").alias(c) for c in _CAPTURED if c != "idle_s"),
        F.coalesce(window, F.lit(0)).alias("window"), window.isNotNull().alias("known"),
        F.coalesce("epoch", F.lit(-1)).alias("epoch"))
    keyed = keyed.withColumn("bucket", _bucket(buckets, "device_id", "window", "known"))
    found = keyed.groupBy("bucket").transformWithState(
        statefulProcessor=Kept(CaptureRule(threshold, forced_snapshot_s), max_compare),
        outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )
    seen = rows.select(F.lit("seen").alias("kind"), "device_id", F.lit(1).cast("long").alias("n"))
    return found.unionByName(seen, allowMissingColumns=True).select(*OUTPUT.names)


def start_loop(
    output: DataFrame, path: str, checkpoint: str, seconds: float | None = S.TICK_SECONDS
) -> StreamingQuery:
    """Write the loop's output to the tables ``captures``, ``layout`` and ``late`` (n rows of
    a device that a micro-batch dropped) under ``path``; with ``seconds=None`` all rows that
    are there are taken and the query ends.

    Each micro-batch overwrites its own folder, so one that is run again
    leaves no row twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # One pass over state and texts: rows that only count are summed up beside the others.
        batch = batch.persist()
        late = batch.where(F.col("kind").isin(*COUNTED)).groupBy("device_id").agg(
            F.sum(F.when(F.col("kind") == "seen", F.col("n")).otherwise(-F.col("n"))).alias("n")).where("n > 0")
        found = batch.where(F.col("kind").isin(*FOUND)).withColumn(
            "table", F.when(F.col("kind") == "layout", "layout").otherwise("captures"))
        rows = found.unionByName(
            late.select(F.lit("late").alias("kind"), "device_id", "n", F.lit("late").alias("table")),
            allowMissingColumns=True)
        # Overwriting only the partition of this micro-batch.
        (
            rows.withColumn("micro_batch", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("table", "micro_batch").parquet(path)
        )
        batch.unpersist()

    writer = output.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()
