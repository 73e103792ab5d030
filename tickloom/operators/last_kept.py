"""Keep-or-drop against the last *kept* row, in parallel.

The decision for a row depends on which earlier row was kept last, so it is a
recurrence and no window function expresses it. Two facts make it parallel:

* Some rows are kept whatever was kept before: the first of a sequence, one that
  comes ``horizon`` seconds or more after the row before it, and one that differs
  from the row before it in a column in which a dropped row never differs from
  the last kept one (``Rule.cuts``). At these *cuts* a sequence falls into runs
  that know nothing of each other. Cuts are found on narrow rows, without the
  texts.
* A row that comes ``horizon`` seconds or more after the last kept one is always
  kept, so what was kept long ago does not matter.

A sequence is cut into time slices. A run that crosses a boundary goes to the
slice it began in, so that every slice starts with a certain row and is decided
in one streaming pass over a sorted partition; no group is ever loaded whole.

Only a run without any cut for more than ``longest`` slices is divided. Each
further slice of it (an *open* one) then also receives the rows of the last two
horizons before it, the *lead-in*. From these the pass works out every state the
sequence can be in when the slice starts, and follows all of them until they
merge. A row kept under some of them is written with those states, and a small
second pass over ids alone picks the state that really occurred. Two horizons
are enough: a state older than that is either replaced inside the lead-in, or
the slice starts after a silence of one horizon and then its first row is kept
under any state.

Rows without a timestamp have no place in a sequence; they are all kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickloom import settings as S
from tickloom.operators.sequence import Order, slice_of, with_earlier
from tickloom.session import write_and_reread

_SLICE, _LEAD, _MICROS, _ONLY_IF = "_slice", "_lead_in", "_micros", "_only_if"


class Rule(Protocol):
    """What decides. ``columns`` are the columns it looks at; the values of a
    row in these columns, as a tuple, are its content."""

    columns: Sequence[str]
    #: Of these, the ones in which a dropped row never differs from the last kept one.
    cuts: Sequence[str]
    horizon_s: float

    def horizon_after(self, kept: tuple) -> float:
        """Seconds after which any row is kept, at most ``horizon_s``."""

    def differs(self, new: tuple, kept: tuple) -> bool:
        """The content alone is reason to keep ``new``."""


class _States:
    """The states a sequence can be in, grouped by content.

    A state is ``[micros, labels]``: when its last kept row was, and under
    which start states it is reached. States with equal content share every
    content decision and differ only in when their horizon ends.
    """

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        # States enter in time order, so the front of a queue is due first.
        self.by_content: dict[tuple, deque] = {}

    def __len__(self) -> int:
        return sum(len(states) for states in self.by_content.values())

    def leave(self, micros: int, content: tuple) -> tuple[bool, list[list]]:
        """Take out the states under which the row is kept."""
        left: list[list] = []
        for kept in list(self.by_content):
            states = self.by_content[kept]
            if self.rule.differs(content, kept):
                left += states
                del self.by_content[kept]
                continue
            due = micros - int(self.rule.horizon_after(kept) * 1_000_000)
            while states and states[0][0] <= due:
                left.append(states.popleft())
            if not states:
                del self.by_content[kept]
        return not self.by_content, left

    def enter(self, micros: int, content: tuple, labels: list) -> None:
        self.by_content.setdefault(content, deque()).append([micros, labels])


class _Decider:
    """Decides the rows of one slice after another, in order."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        self.states = _States(rule)
        self.in_lead = True
        self.certain = False

    def lead_in(self, micros: int, content: tuple, tie: Any) -> None:
        # The row may have been kept under a state not known here, so it is a
        # state of its own in any case; states under which it is kept end.
        self.states.leave(micros, content)
        self.states.enter(micros, content, [(micros, tie)])

    def decide(self, micros: int, content: tuple) -> tuple[bool, list | None]:
        """(kept under some state, the start states if not under all)."""
        if self.in_lead:
            self.in_lead = False
            self.certain = len(self.states) <= 1
        if self.certain:
            kept = self._decide_certain(micros, content)
            return kept, None
        all_left, left = self.states.leave(micros, content)
        if not left:
            return False, None
        labels = [label for state in left for label in state[1]]
        self.states.enter(micros, content, labels)
        if all_left:
            self.certain = True
            return True, None
        return True, labels

    def _decide_certain(self, micros: int, content: tuple) -> bool:
        if not self.states.by_content:
            self.states.enter(micros, content, [])
            return True
        _, left = self.states.leave(micros, content)
        if left:
            self.states.enter(micros, content, [])
        return bool(left)


def _values(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values, by the fast way where Arrow has one."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = column.type
    if pa.types.is_string(kind) or (
        column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind))
    ):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _decide_slices(
    batches: Iterator[pa.RecordBatch], rule: Rule, keys: list[str], tie: str
) -> Iterator[pa.RecordBatch]:
    current, decider = None, None
    label_type = pa.list_(pa.struct([("micros", pa.int64()), ("tie", pa.int64())]))
    for batch in batches:
        groups = list(zip(*(_values(batch, k) for k in [*keys, _SLICE])))
        micros, ties, leads = (_values(batch, c) for c in (_MICROS, tie, _LEAD))
        contents = list(zip(*(_values(batch, c) for c in rule.columns)))
        mask, only_if = [], []
        for i, group in enumerate(groups):
            if group != current:
                current, decider = group, _Decider(rule)
            if leads[i]:
                decider.lead_in(micros[i], contents[i], ties[i])
                mask.append(False)
                continue
            kept, labels = decider.decide(micros[i], contents[i])
            mask.append(kept)
            if kept:
                only_if.append(
                    None if labels is None else [{"micros": m, "tie": t} for m, t in labels]
                )
        kept_rows = batch.filter(pa.array(mask, pa.bool_()))
        if kept_rows.num_rows:
            yield pa.RecordBatch.from_arrays(
                [*kept_rows.columns, pa.array(only_if, label_type)],
                names=[*batch.schema.names, _ONLY_IF],
            )


def _follow(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Walk the undecided rows of a sequence, one line per start state, and
    pick those really kept."""
    current = slice_no = last = start = None
    for batch in batches:
        groups = zip(*(_values(batch, k) for k in keys))
        columns = (_values(batch, c) for c in (_SLICE, _MICROS, "_tie", "_if_micros", "_if_tie"))
        certain = _values(batch, "_certain")
        picked = []
        for group, is_certain, row_slice, micros, tie, if_micros, if_tie in zip(
            groups, certain, *columns
        ):
            if group != current:
                current, slice_no, last = group, None, None
            if row_slice != slice_no:
                slice_no, start = row_slice, last
            kept = not is_certain and start == (if_micros, if_tie)
            if kept or is_certain:
                last = (micros, tie)
            picked.append(kept)
        yield batch.filter(pa.array(picked, pa.bool_())).select(
            [*keys, _SLICE, _MICROS, "_tie"]
        )


def _heads(
    df: DataFrame, keys: list[str], order: Order, rule: Rule, slice_s: float, longest: int
) -> DataFrame:
    """Per sequence and slice: its first cut, the last slice before it that has
    one, and whether the rows before its first cut are an open slice."""
    seen = with_earlier(
        df.select(*keys, order.ts, order.tie, *rule.cuts), keys, order,
        previous={"_before": F.struct(F.col(order.ts).alias("ts"), *rule.cuts)}, slice_s=slice_s,
    )
    gap = F.unix_micros(order.ts) - F.unix_micros("_before.ts") >= F.lit(
        int(rule.horizon_s * 1_000_000))
    cut = F.col("_before").isNull() | gap
    for c in rule.cuts:
        cut = cut | ~F.col(c).eqNullSafe(F.col("_before")[c])
    place = F.struct(F.unix_micros(order.ts).alias("micros"), F.col(order.tie).alias("tie"))
    first = seen.groupBy(*keys, slice_of(F.col(order.ts), slice_s).alias("_home")).agg(
        F.min(F.when(cut, place)).alias("_cut"))
    before = Window.partitionBy(*keys).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("_cut").isNotNull(), F.col("_home")), True).over(before)
    return first.withColumn("_owner", owner).withColumn(
        "_open", F.coalesce(F.col("_home") - F.col("_owner") > longest, F.lit(False)))


def _same(keys: list[str], other: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]


def keep_against_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    rule: Rule,
    slice_s: float = S.RECURRENCE_SLICE_S,
    longest: int = 7,
) -> DataFrame:
    """The rows of ``df`` that ``rule`` keeps, per sequence ``keys``.

    ``order.tie`` must be a BIGINT that makes (ts, tie) unique in a sequence.
    ``slice_s`` is two horizons at least. The decided rows are stored once in
    the shared folder, so that the Python pass over all texts runs a single time; so
    are the rows of ``df`` before it, which the cuts, the slices and the lead-ins read.
    """
    keys, payload = list(keys), df.columns
    horizon = rule.horizon_s
    if slice_s < 2 * horizon:
        raise ValueError(f"slice_s must be two horizons at least, {2 * horizon} seconds")
    df = write_and_reread(df)
    nowhere = df.where(F.col(order.ts).isNull())
    df = df.where(F.col(order.ts).isNotNull())
    heads = write_and_reread(_heads(df, keys, order, rule, slice_s, longest))
    divided = not heads.where("_open").isEmpty()
    named = heads.select(
        *(F.col(k).alias(f"_h{k}") for k in keys), F.col("_home").alias("_hhome"), "_cut", "_owner", "_open")
    home = slice_of(F.col(order.ts), slice_s)
    placed = df.withColumn("_home", home).withColumn(_MICROS, F.unix_micros(F.col(order.ts)))
    here = placed.join(named, [*_same(keys, "_h"), F.col("_home") == F.col("_hhome")])
    early = F.col("_cut").isNull() | (
        F.struct(F.col(_MICROS).alias("micros"), F.col(order.tie).alias("tie")) < F.col("_cut"))
    # Two units to a slice: what is open, and what starts with a cut.
    unit = (
        F.when(early & F.col("_open"), 2 * F.col("_home"))
        .when(early, 2 * F.col("_owner") + 1).otherwise(2 * F.col("_home") + 1))
    columns = [*payload, _MICROS]
    own = here.select(*columns, unit.alias(_SLICE), F.lit(False).alias(_LEAD))
    if divided:
        reach = F.floor(
            (F.col(_MICROS) + F.lit(int(2 * horizon * 1_000_000))) / F.lit(int(slice_s * 1_000_000)))
        leads = placed.where(reach > F.col("_home")).join(
            named.where("_open"), [*_same(keys, "_h"), F.col("_home") + 1 == F.col("_hhome")]
        ).select(*columns, (2 * F.col("_hhome")).alias(_SLICE), F.lit(True).alias(_LEAD))
        own = own.unionByName(leads)
    sliced = (
        own.repartition(*keys, _SLICE)
        .sortWithinPartitions(*keys, _SLICE, F.col(_LEAD).desc(), _MICROS, order.tie)
    )
    label = T.ArrayType(
        T.StructType([T.StructField("micros", T.LongType()), T.StructField("tie", T.LongType())])
    )
    out = T.StructType([*sliced.schema.fields, T.StructField(_ONLY_IF, label)])
    tie = order.tie
    decided = write_and_reread(
        sliced.mapInArrow(lambda it: _decide_slices(it, rule, keys, tie), out)
    )

    if not divided:
        # Every slice starts with a certain row: nothing is left undecided.
        return decided.select(*payload).unionByName(nowhere)

    # Slices with undecided rows, and the last certain row of the slices they
    # may have to look back to: ids only.
    open_rows = decided.filter(F.col(_ONLY_IF).isNotNull())
    open_keys = open_rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    same_key = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    anchors = (
        decided.filter(F.col(_ONLY_IF).isNull())
        .groupBy(*keys, _SLICE)
        .agg(F.max(F.struct(_MICROS, F.col(order.tie).alias("_tie"))).alias("_at"))
        .join(open_keys, same_key, "left_semi")
        .select(
            *keys, _SLICE, "_at.*", F.lit(True).alias("_certain"),
            F.lit(0).cast("long").alias("_if_micros"), F.lit(0).cast("long").alias("_if_tie"),
        )
    )
    walk = (
        open_rows.select(
            *keys, _SLICE, _MICROS, F.col(order.tie).alias("_tie"),
            F.explode(_ONLY_IF).alias("_if"),
        )
        .select(
            *keys, _SLICE, _MICROS, "_tie", F.lit(False).alias("_certain"),
            F.col("_if")["micros"].alias("_if_micros"), F.col("_if")["tie"].alias("_if_tie"),
        )
        .unionByName(anchors)
    )
    walk = walk.repartition(*keys).sortWithinPartitions(*keys, _SLICE, _MICROS, "_tie")
    found_schema = T.StructType([
        f for f in walk.schema.fields if f.name in {*keys, _SLICE, _MICROS, "_tie"}
    ])
    found = walk.mapInArrow(lambda it: _follow(it, keys), found_schema)
    found = found.select(*(F.col(c).alias(f"_f{c}") for c in found.columns))
    same_row = [
        F.col(c).eqNullSafe(F.col(f"_f{c}")) for c in keys
    ] + [
        F.col(_SLICE) == F.col(f"_f{_SLICE}"),
        F.col(_MICROS) == F.col(f"_f{_MICROS}"),
        F.col(order.tie) == F.col("_f_tie"),
    ]
    settled = open_rows.join(found, same_row, "left_semi")
    certain = decided.filter(F.col(_ONLY_IF).isNull())
    return certain.select(*payload).unionByName(settled.select(*payload)).unionByName(nowhere)
