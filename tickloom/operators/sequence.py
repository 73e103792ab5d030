"""Ordered operators that never need one whole key in one task.

A window function over a device puts all rows of that device into one task. A
busy device may hold a third of all rows, so the sequences here are cut into
time slices ``(keys, slice)``. Each slice is sorted by itself; what a slice
must know about the time before it arrives as one *carry row*, computed from
one small row per slice. Only those small rows are ever grouped by the bare
keys, and the rows themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tickloom import settings as S

SLICE = "_slice"
CARRY = "_carry"


@dataclass(frozen=True)
class Order:
    """What orders a sequence: a timestamp, then a tie breaker."""

    ts: str = "ts"
    tie: str = "id"

    def struct(self) -> Column:
        return F.struct(F.col(self.ts).alias("o0"), F.col(self.tie).alias("o1"))

    def columns(self) -> list[Column]:
        return [F.col(self.ts), F.col(self.tie)]


def slice_of(ts: Column, seconds: float) -> Column:
    """Number of the time slice an instant falls in."""
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000)))


def with_earlier(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    previous: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    slice_s: float = S.SLICE_S,
) -> DataFrame:
    """Add columns that look back along a sequence.

    ``previous``: value of the row just before, NULL at the start.
    ``latest``: last non-NULL value up to and including this row.
    ``running``: sum of a number up to and including this row.
    """
    previous, latest, running = previous or {}, latest or {}, running or {}
    keys = list(keys)
    payload = df.columns
    values = df.select(
        "*",
        slice_of(F.col(order.ts), slice_s).alias(SLICE),
        *(
            [F.struct(*(c.alias(n) for n, c in previous.items())).alias("_prev")]
            if previous else []
        ),
        *(c.alias(f"_latest_{n}") for n, c in latest.items()),
        *(F.coalesce(c, F.lit(0)).alias(f"_run_{n}") for n, c in running.items()),
    )

    # One row per slice: its last row, its last non-NULL values, its sums. All
    # of these combine map-side, so a crowded key costs no more than another.
    tail = [F.count(F.lit(1)).alias("_n")]
    if previous:
        tail.append(F.max_by("_prev", order.struct()).alias("_prev"))
    for name in latest:
        col = f"_latest_{name}"
        tail.append(
            F.max_by(col, F.when(F.col(col).isNotNull(), order.struct())).alias(col)
        )
    for name in running:
        tail.append(F.sum(f"_run_{name}").alias(f"_run_{name}"))
    first_ts = F.min(order.ts).alias(order.ts)
    summary = values.groupBy(*keys, SLICE).agg(first_ts, *tail)

    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = []
    if previous:
        carried.append(F.last("_prev").over(before).alias("_prev"))
    for name in latest:
        carried.append(F.last(f"_latest_{name}", True).over(before).alias(f"_latest_{name}"))
    for name in running:
        carried.append(
            F.coalesce(F.sum(f"_run_{name}").over(before), F.lit(0)).alias(f"_run_{name}")
        )
    carry_rows = summary.select(
        *keys, SLICE, order.ts, *carried, F.count("_n").over(before).alias("_earlier")
    ).filter("_earlier > 0").drop("_earlier")

    both = values.withColumn(CARRY, F.lit(False)).unionByName(
        carry_rows.withColumn(CARRY, F.lit(True)), allowMissingColumns=True
    )
    # The carry row sorts before all rows of its slice.
    ordered = Window.partitionBy(*keys, SLICE).orderBy(
        F.col(CARRY).desc(), *order.columns()
    )
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    looked = both.select(
        *payload,
        CARRY,
        *([F.lag("_prev").over(ordered).alias("_prev")] if previous else []),
        *(F.last(f"_latest_{n}", True).over(upto).alias(n) for n in latest),
        *(F.sum(f"_run_{n}").over(upto).alias(n) for n in running),
    )
    return looked.filter(~F.col(CARRY)).select(
        *payload,
        *(F.col("_prev")[n].alias(n) for n in previous),
        *latest,
        *running,
    )


def segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    carry: Sequence[str],
    starts: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    sums: Sequence[str] = (),
    slice_s: float = S.SLICE_S,
) -> DataFrame:
    """Cut sequences into segments and describe each by one row.

    ``starts(before, here)`` says whether a row begins a new segment; both
    arguments look up a column of ``carry`` (the timestamp is always there) in
    the row before and in the row itself. Returns keys, ``start_ts``,
    ``end_ts``, ``n``, a ``head`` and a ``tail`` struct with the carried
    columns of the first and last row, the sums, and ``sum_*`` columns.

    Segments are built inside time slices first. Only the first and the last
    one of a slice can continue elsewhere, so only those are stitched.
    """
    keys, fields = list(keys), list(dict.fromkeys([order.ts, *carry]))
    row = F.struct(*fields)
    in_slice = Window.partitionBy(*keys, SLICE).orderBy(*order.columns())
    cut = (
        df.withColumn(SLICE, slice_of(F.col(order.ts), slice_s))
        .withColumn("_row", row)
        .withColumn("_before", F.lag("_row").over(in_slice))
    )
    begins = F.col("_before").isNull() | starts(
        lambda c: F.col("_before")[c], lambda c: F.col("_row")[c]
    )
    numbered = cut.withColumn(
        "_no",
        F.sum(F.when(begins, 1).otherwise(0)).over(
            in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    local = numbered.groupBy(*keys, SLICE, "_no").agg(
        F.min(order.ts).alias("start_ts"),
        F.max(order.ts).alias("end_ts"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("_row", order.struct()).alias("head"),
        F.max_by("_row", order.struct()).alias("tail"),
        *(F.sum(c).alias(f"sum_{c}") for c in sums),
    )
    whole_slice = Window.partitionBy(*keys, SLICE)
    local = local.withColumn("_last", F.max("_no").over(whole_slice))
    at_edge = (F.col("_no") == 1) | (F.col("_no") == F.col("_last"))
    columns = [*keys, "start_ts", "end_ts", "n", "head", "tail", *(f"sum_{c}" for c in sums)]

    along = Window.partitionBy(*keys).orderBy(SLICE, "_no")
    edges = local.filter(at_edge).withColumn("_before", F.lag("tail").over(along))
    # Only the first segment of a slice can continue the one before it.
    apart = (
        F.col("_before").isNull()
        | (F.col("_no") > 1)
        | starts(lambda c: F.col("_before")[c], lambda c: F.col("head")[c])
    )
    stitched = (
        edges.withColumn("_apart", F.when(apart, 1).otherwise(0))
        .withColumn(
            "_no2",
            F.sum("_apart").over(
                along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .groupBy(*keys, "_no2")
        .agg(
            F.min("start_ts").alias("start_ts"),
            F.max("end_ts").alias("end_ts"),
            F.sum("n").alias("n"),
            F.min_by("head", F.struct(SLICE, "_no")).alias("head"),
            F.max_by("tail", F.struct(SLICE, "_no")).alias("tail"),
            *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums),
        )
    )
    return local.filter(~at_edge).select(*columns).unionByName(stitched.select(*columns))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_tie: str,
    columns: Sequence[str],
    slice_s: float = S.SLICE_S,
) -> DataFrame:
    """For each left row, ``columns`` of the latest right row not after it.

    Left rows without one stay, with NULLs. Both sides are laid on one time
    line and the last right value is carried along it, so neither pairs of
    rows nor a whole key have to be held.
    """
    keys = list(keys)
    # The match itself must not be NULL, whatever its columns hold.
    found = F.struct(F.col(right_ts).alias("_rts"), *columns)
    line = left.select(
        "*", F.col(left_ts).alias("_ts"), F.lit(1).alias("_side")
    ).unionByName(
        right.select(
            *keys,
            F.col(right_ts).alias("_ts"),
            F.lit(0).alias("_side"),
            F.col(right_tie).alias("_rtie"),
            found.alias("_found"),
        ),
        allowMissingColumns=True,
    )
    # At one instant all right rows come before all left rows.
    line = line.withColumn("_tie", F.struct("_side", "_rtie"))
    looked = with_earlier(
        line, keys, Order("_ts", "_tie"), latest={"_match": F.col("_found")}, slice_s=slice_s
    )
    return looked.filter(F.col("_side") == 1).select(
        *left.columns, *(F.col("_match")[c].alias(c) for c in columns)
    )


def trailing_window(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, slice_s: float = S.SLICE_S
) -> tuple[DataFrame, WindowSpec]:
    """Rows plus a window over the last ``seconds`` up to each row.

    Rows near the end of a slice are also given to the next slice, flagged
    ``_carry``; drop those rows after the window function has run. A slice is
    made at least as long as the window.
    """
    slice_s = max(slice_s, seconds)
    here = slice_of(F.col(ts), slice_s)
    reaches = slice_of(F.col(ts) + F.expr(f"INTERVAL {int(seconds)} SECONDS"), slice_s)
    spread = (
        df.withColumn("_home", here)
        .withColumn(SLICE, F.explode(F.sequence(here, reaches)))
        .withColumn(CARRY, F.col(SLICE) != F.col("_home"))
        .drop("_home")
    )
    # Microseconds: two rows 300.4 s apart are not within 300 s.
    window = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(F.unix_micros(F.col(ts)))
        .rangeBetween(-int(seconds) * 1_000_000, Window.currentRow)
    )
    return spread, window
