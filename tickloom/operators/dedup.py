"""Near-duplicate removal for captures, and the report on it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from typing import ClassVar

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import settings as S
from tickloom.operators.last_kept import keep_against_last
from tickloom.operators.sequence import Order, with_earlier


@dataclass
class CaptureRule:
    """A capture is kept when it is the first, when app, url or title changed,
    when the snapshot is due, or when its text is not similar enough.

    A url that disappears is no change; NULL text counts as empty.
    """

    threshold: float = S.SIMILARITY_THRESHOLD
    horizon_s: float = S.FORCED_SNAPSHOT_S
    _matchers: dict = field(default_factory=dict, repr=False, compare=False)
    _answers: dict = field(default_factory=dict, repr=False, compare=False)

    # Texts arrive cut to the length that is compared.
    columns: ClassVar[list[str]] = ["_app", "_title", "_url", "_text"]
    cuts: ClassVar[list[str]] = ["_app", "_title"]
    _REMEMBERED: ClassVar[int] = 512

    def horizon_after(self, kept: tuple) -> float:
        return self.horizon_s

    def differs(self, new: tuple, kept: tuple) -> bool:
        if new[0] != kept[0] or new[1] != kept[1]:
            return True
        if new[2] and new[2] != kept[2]:
            return True
        return not self._similar(new[3] or "", kept[3] or "")

    def _similar(self, new: str, last: str) -> bool:
        if self.threshold <= 0 or new == last:
            return 1.0 >= self.threshold
        if not new or not last:
            return 0.0 >= self.threshold
        # Cheap upper bounds first: lengths, then letters in common.
        if 2.0 * min(len(new), len(last)) / (len(new) + len(last)) < self.threshold:
            return False
        # Slices follow several states at once and so ask for a pair again.
        answer = self._answers.get((new, last))
        if answer is None:
            answer = self._compare(new, last)
            if len(self._answers) >= self._REMEMBERED:
                self._answers.clear()
            self._answers[new, last] = answer
        return answer

    def _compare(self, new: str, last: str) -> bool:
        # What both begin and end with settles most pairs without a matcher. Letters
        # in common bound the ratio from above: those of the ends, and of the rests.
        total = len(new) + len(last)
        begin = _common_beginning(new, last)
        a, b = new[begin:], last[begin:]
        end = _common_beginning(a[::-1], b[::-1])
        # The first block that is matched is the longest one there is, unless the
        # last text is so long that the matcher leaves its frequent letters out. Where
        # one end is that block, the other end is found beside it.
        if len(last) < _LEAVES_OUT and 2.0 * (begin + end) / total >= self.threshold and (
            2.0 * max(begin, end) / total >= self.threshold or _end_comes_first(new, last, begin, end)
        ):
            return True
        counts = Counter(b[:len(b) - end])
        shared = sum(min(n, counts[c]) for c, n in Counter(a[:len(a) - end]).items() if c in counts)
        if 2.0 * (begin + end + shared) / total < self.threshold:
            return False
        matcher = self._matchers.get(last)
        if matcher is None:
            if len(self._matchers) >= self._REMEMBERED:
                self._matchers.clear()
            # The matcher indexes its second text once; many new texts are
            # compared with one kept text.
            matcher = self._matchers[last] = SequenceMatcher(None, "", last)
        matcher.set_seq1(new)
        return matcher.ratio() >= self.threshold


def _end_comes_first(new: str, last: str, begin: int, end: int) -> bool:
    """The longer of the common ends is the block that is matched first: no other is
    longer, and of equal ones the first in ``new``, then in ``last``, is taken."""
    if begin >= end:
        return not any(new[i:i + begin + 1] in last for i in range(len(new) - begin))
    return last.find(new[-end:]) == len(last) - end and not any(
        new[i:i + end] in last for i in range(len(new) - end))


#: Length of a second text from which ``SequenceMatcher`` leaves frequent letters out.
_LEAVES_OUT = 200


def _common_beginning(a: str, b: str) -> int:
    """How many characters both texts begin with."""
    same, differs = 0, min(len(a), len(b)) + 1
    while differs - same > 1:
        middle = (same + differs) // 2
        if a[same:middle] == b[same:middle]:
            same = middle
        else:
            differs = middle
    return same


def dedup(
    captures: DataFrame,
    keys: Sequence[str] = ("device_id", "window_id"),
    order: Order = Order("ts", "id"),
    threshold: float = S.SIMILARITY_THRESHOLD,
    forced_snapshot_s: float = S.FORCED_SNAPSHOT_S,
    max_compare: int = S.MAX_TEXT_COMPARE,
    slice_s: float = S.RECURRENCE_SLICE_S,
) -> DataFrame:
    """The captures left after dropping near-duplicates of the last kept one.

    ``keys`` name one sequence: a window of a device, with the epoch added
    where idle stretches start it anew.
    """
    compared = captures.select(
        "*",
        F.col("app").alias("_app"),
        F.col("title").alias("_title"),
        F.col("url").alias("_url"),
        F.left(F.col("text"), F.lit(max_compare)).alias("_text"),
    )
    rule = CaptureRule(threshold, forced_snapshot_s)
    return keep_against_last(compared, keys, order, rule, slice_s).select(*captures.columns)


def _changed(before: str, here: str, first: str) -> Column:
    return F.col(first).isNotNull() & ~F.col(before).eqNullSafe(F.col(here))


def count_transitions(
    df: DataFrame, keys: Sequence[str], order: Order, slice_s: float = S.SLICE_S
) -> DataFrame:
    """Per sequence: rows and changes of app from one row to the next."""
    seen = with_earlier(
        df.select(*keys, order.ts, order.tie, "app"),
        keys, order,
        previous={"_app_before": F.col("app"), "_there": F.lit(True)},
        slice_s=slice_s,
    )
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(_changed("_app_before", "app", "_there"), 1).otherwise(0)).alias("transitions"),
    )


def dedup_report(
    raw: DataFrame,
    kept: DataFrame,
    keys: Sequence[str],
    order: Order = Order("ts", "id"),
    slice_s: float = S.SLICE_S,
) -> DataFrame:
    """Per sequence: rows and app changes before and after, and the reduction."""
    before = count_transitions(raw, keys, order, slice_s).select(
        *keys, F.col("n").alias("n_raw"), F.col("transitions").alias("transitions_raw")
    )
    after = count_transitions(kept, keys, order, slice_s).select(
        *keys, F.col("n").alias("n_kept"), F.col("transitions").alias("transitions_kept")
    )
    return before.join(after, list(keys), "left").select(
        *keys,
        "n_raw",
        F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        (1 - F.coalesce("n_kept", F.lit(0)) / F.col("n_raw")).alias("reduction"),
        "transitions_raw",
        F.coalesce("transitions_kept", F.lit(0)).alias("transitions_kept"),
    )
