"""Windows on screen: which ones count, and which element each one shows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import settings as S
from tickloom.session import write_and_reread


def filter_visible(
    observations: DataFrame,
    excluded: Sequence[str] = S.SYSTEM_OWNERS,
    min_side: int = S.MIN_WINDOW_SIDE,
) -> DataFrame:
    """Ordinary application windows: layer 0, no system owner, not tiny.

    A missing layer is no layer 0; a missing owner is an empty name, and a
    missing side has length 0.
    """
    bounds = F.col("bounds")
    return observations.filter(
        (F.coalesce("layer", F.lit(-1)) == 0)
        & ~F.coalesce("app", F.lit("")).isin(list(excluded))
        & (F.coalesce(bounds["Width"].cast("int"), F.lit(0)) >= min_side)
        & (F.coalesce(bounds["Height"].cast("int"), F.lit(0)) >= min_side)
    )


TICK = ("device_id", "tick_ts")


def matched_ticks(observations: DataFrame, tick: Sequence[str] = TICK) -> DataFrame:
    """Ticks in which some window has an element. The flags are combined per
    tick map-side, so this is small against the observations."""
    return (
        observations.groupBy(*tick)
        .agg(F.bool_or("matched").alias("_any"))
        .filter("_any")
        .select(*tick)
    )


def drop_unmatched_ticks(observations: DataFrame, tick: Sequence[str] = TICK) -> DataFrame:
    """Drop ticks in which no window has an element: a screen in transition."""
    return observations.join(matched_ticks(observations, tick), list(tick), "left_semi")


def _near(a: Column, b: Column, tolerance: int) -> Column:
    return F.abs(a - b) <= tolerance


SIDES = ["X", "Y", "Width", "Height"]


def match_windows(
    windows: DataFrame,
    elements: DataFrame,
    process: Sequence[str] = ("device_id", "tick_ts", "pid"),
    tolerance: int = S.BOUNDS_TOLERANCE,
    payload: Sequence[str] = (),
    few: int = S.FEW_ELEMENTS,
) -> DataFrame:
    """Give each window an element of its process.

    In this order: the first element with the same non-empty title; the first
    whose four bounds each lie within the tolerance; the only element of the
    process. Adds ``ax_order`` (NULL when nothing matched), ``match_kind``
    (title, bounds, only) and the element's ``payload`` columns. One element
    may serve several windows.

    ``windows`` has title and bounds, ``elements`` has ax_order, title and
    bounds. A process of at most ``few`` elements is one row that its windows
    are joined to, so either side is shuffled once. Processes with more are
    counted first and go through joins by title and by place.
    """
    if few < 1:
        raise ValueError("few must be 1 at least: the only element of a process is among the few")
    process = list(process)
    known = reduce(and_, [F.col(c).isNotNull() for c in process])
    elements = elements.filter(known)
    crowded = write_and_reread(
        elements.groupBy(*process).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > few).drop("_n"))
    if crowded.isEmpty():
        return _match_few(windows, elements, process, tolerance, payload)
    return _match_few(
        windows.join(crowded, process, "left_anti"), elements.join(crowded, process, "left_anti"),
        process, tolerance, payload,
    ).unionByName(_match_many(
        windows.join(crowded, process, "left_semi"), elements.join(crowded, process, "left_semi"),
        process, tolerance, payload,
    ))


def _match_few(
    windows: DataFrame, elements: DataFrame, process: list[str], tolerance: int, payload: Sequence[str]
) -> DataFrame:
    """Windows against the elements of their process as an array, in order."""
    element = F.struct(
        "ax_order", *payload, F.col("title").alias("_title"), *(F.col("bounds")[s].alias(f"_e{s}") for s in SIDES))
    # An element without an order is none to choose, but it counts.
    grouped = elements.groupBy(*process).agg(
        F.count(F.lit(1)).alias("_n"),
        F.collect_list(F.when(F.col("ax_order").isNotNull(), element)).alias("_elements"),
    ).withColumn("_elements", F.array_sort(
        "_elements",
        lambda a, b: F.when(a["ax_order"] < b["ax_order"], -1).when(a["ax_order"] > b["ax_order"], 1).otherwise(0),
    ))

    def first(kind: str, fits: Callable[[Column], Column]) -> Column:
        chosen = F.transform(F.filter("_elements", fits), lambda e: F.struct(
            *(e[c].alias(c) for c in ["ax_order", *payload]), F.lit(kind).alias("match_kind")))
        return F.get(chosen, F.lit(0))

    def same_title(e: Column) -> Column:
        return (F.col("title") != "") & (e["_title"] == F.col("title"))

    def same_place(e: Column) -> Column:
        # A difference out of range is no small one.
        return reduce(and_, [
            F.try_subtract(F.col("bounds")[s], e[f"_e{s}"]).between(-tolerance, tolerance) for s in SIDES])

    found = F.coalesce(
        first("title", same_title),
        first("bounds", same_place),
        F.when(F.col("_n") == 1, first("only", lambda e: F.lit(True))),
    )
    joined = windows.join(grouped, process, "left").select(*windows.columns, found.alias("_found"))
    return joined.select(
        *windows.columns, *(F.col("_found")[c].alias(c) for c in ["ax_order", *payload, "match_kind"]))


def _match_many(
    windows: DataFrame, elements: DataFrame, process: list[str], tolerance: int, payload: Sequence[str]
) -> DataFrame:
    """Windows against processes of more than one element. Each step is an
    equality join against a side that is unique in the join key, so a process
    with very many windows makes no pairs. The tolerance becomes an equality on
    grid cells, over distinct bounds only."""
    element = F.struct("ax_order", *payload)

    def first_by(keys: list[str], source: DataFrame, name: str) -> DataFrame:
        return source.groupBy(*keys).agg(F.min_by(element, "ax_order").alias(name))

    by_title = first_by(
        [*process, "title"], elements.filter(F.col("title") != ""), "_by_title"
    )

    # Bounds: elements stand in one cell of a grid, windows look into every
    # cell their tolerance reaches (mostly one, since a cell is much larger).
    cell = 8 * max(tolerance, 1)
    element_bounds = first_by(
        [*process, *(f"_e{s}" for s in SIDES)],
        elements.filter(F.col("bounds").isNotNull()).select(
            *process, "ax_order", *payload,
            *(F.col("bounds")[s].alias(f"_e{s}") for s in SIDES),
        ),
        "_candidate",
    ).withColumns({f"_c{s}": F.floor(F.col(f"_e{s}") / cell) for s in SIDES})
    window_bounds = (
        windows.filter(F.col("bounds").isNotNull())
        .select(*process, *(F.col("bounds")[s].alias(f"_w{s}") for s in SIDES))
        .distinct()
    )
    looking = window_bounds
    for s in SIDES:
        low = F.floor((F.col(f"_w{s}") - tolerance) / cell)
        high = F.floor((F.col(f"_w{s}") + tolerance) / cell)
        looking = looking.withColumn(f"_c{s}", F.explode(F.sequence(low, high)))
    near = looking.join(element_bounds, [*process, *(f"_c{s}" for s in SIDES)])
    for s in SIDES:
        near = near.filter(_near(F.col(f"_w{s}"), F.col(f"_e{s}"), tolerance))
    by_bounds = near.groupBy(*process, *(f"_w{s}" for s in SIDES)).agg(
        F.min_by("_candidate", F.col("_candidate")["ax_order"]).alias("_by_bounds")
    )

    keyed = windows.withColumns({f"_w{s}": F.col("bounds")[s] for s in SIDES})
    joined = (
        keyed.join(by_title, [*process, "title"], "left")
        .join(by_bounds, [*process, *(f"_w{s}" for s in SIDES)], "left")
    )
    chosen = F.coalesce("_by_title", "_by_bounds")
    return joined.select(
        *windows.columns,
        *(chosen[c].alias(c) for c in ["ax_order", *payload]),
        F.when(F.col("_by_title").isNotNull(), "title")
        .when(F.col("_by_bounds").isNotNull(), "bounds")
        .alias("match_kind"),
    )


def panes(observations: DataFrame, *also: Column) -> DataFrame:
    """One row per tick: its windows, front to back, as ``panes``.

    A tick is what one screen shows at one moment, so the array is small.
    ``also`` are further aggregates to have per tick.
    """
    pane = F.struct("z", "window_id", "app", "pid", "title", "bounds")
    return (
        observations.groupBy("device_id", "tick_ts")
        .agg(F.array_sort(F.collect_list(pane)).alias("_panes"), *also)
        .withColumn(
            "panes",
            F.transform(
                "_panes",
                lambda p: F.struct(
                    p["window_id"].alias("window_id"),
                    p["app"].alias("app"),
                    p["pid"].alias("pid"),
                    p["title"].alias("title"),
                    p["bounds"].alias("bounds"),
                ),
            ),
        )
        .drop("_panes")
    )


def panes_json(column: str = "panes") -> Column:
    return F.to_json(F.col(column), {"ignoreNullFields": "false"})
