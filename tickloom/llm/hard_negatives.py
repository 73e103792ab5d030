"""Hard negatives: rows of other labels that score nearly as high as an anchor's positives.

Search by coordinates, as in LEMP. Rows are dealt to cells by hash. In a cell they
stand in buckets of similar length, the longest first, and each bucket has a sorted
list of every coordinate of its vectors, brought to length one, that some anchor
asks for. A score that an anchor still needs becomes, with the bucket's greatest
length, a least cosine; from it follows, for each of the anchor's largest
coordinates (its focus), the range in which that coordinate of a row must lie. The
ranges are read off the sorted lists and intersected; the rows that are left are
scored exactly, in integers, and raise the needed score for the next bucket. A bucket
that is too short for it ends the search.

Two searches: the best rows of the anchor's own label (its positives), in cells of
one label; then, for every positive, the best rows of other labels whose score is
within ``low`` to ``high`` per cent of the positive's. There an anchor goes only to
cells whose longest row can reach the least score it needs. The result is exact: the
ranges are only ever wider than needed.

Cells are of bounded size whatever the size of a label, and hold whole tables of rows
or anchors for no one; labels and lengths are counted by Spark and joined, never
collected. The work grows with anchors times rows where the ranges are wide: vectors
without structure, as random ones in many dimensions, leave nothing out.

Results for unusual rows: rows with NULL id, label or vector, or with NULL or non-finite
components, take no part, nor do those whose integer components squared sum to 2**63
or more, since scores would not fit. Zero and empty vectors take part. Scores exist
between vectors of one dimension; others never meet. Of rows that share an id the
least by label, then vector, counts. Ties go to the smaller id. Empty tables, and
anchors without positives, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import write_and_reread

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in per cent of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows and anchors of a cell, rows of a bucket, focus coordinates.
SHARD, BLOCK, BUCKET, FOCUS = 10_000, 4_000, 2_000, 4
#: A range that leaves more than this share in is not looked up: scoring is cheaper.
WIDE = 0.7
_EXACT = float(1 << 53)


class Bucket:
    """Rows of similar length, with sorted lists of their coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest = lengths[0] if len(lengths) else 0.0
        self._floats = vectors.astype(np.float64)
        self._unit = self._floats / np.maximum(lengths, 1e-300)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self._unit[:, f], kind="stable")
            self._lists[f] = order, self._unit[order, f]
        return self._lists[f]

    def candidates(self, focus: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows that can have this cosine with ``unit``; None: perhaps all."""
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= 0:
            return None
        # All directions within an angle of the anchor's: so is each coordinate's angle.
        angle, wide = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(cosine)
        low = np.cos(np.minimum(angle + wide, np.pi)) - 1e-9
        high = np.cos(np.maximum(angle - wide, 0)) + 1e-9
        spans = []
        for f, a, b in zip(focus.tolist(), low, high):
            order, values = self._list(f)
            spans.append((order, *values.searchsorted([a, b + 1e-300], side="left")))
        sizes = [end - begin for _, begin, end in spans]
        best = int(np.argmin(sizes))
        if sizes[best] > WIDE * len(self.ids):
            return None
        order, begin, end = spans[best]
        rows = order[begin:end]
        for k, f in enumerate(focus.tolist()):
            if k != best:
                value = self._unit[rows, f]
                rows = rows[(value >= low[k]) & (value <= high[k])]
        return rows

    def scores(self, rows: np.ndarray | slice, queries: np.ndarray, longest: float) -> np.ndarray:
        """Exact inner products, as integers. Sums below 2**53 are exact in doubles."""
        if self.longest * longest < _EXACT / 2:
            return (self._floats[rows] @ queries.T.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ queries.T


def buckets(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[Bucket]:
    """Rows in buckets, the longest first."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    return [Bucket(ids[part], labels[part], vectors[part], lengths[part])
            for a in range(0, len(order), BUCKET) for part in [order[a:a + BUCKET]]]


class Goal:
    """The ``k`` best rows with scores from ``low`` to ``high``."""

    __slots__ = ("k", "low", "high", "scores", "ids")

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def needed(self) -> float:
        """Rows below this score are of no use."""
        if len(self.ids) == self.k:
            return float(self.scores[-1])
        return -np.inf if self.low is None else float(self.low)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = np.ones(len(ids), bool) if self.low is None else (scores >= self.low) & (scores <= self.high)
        if len(self.ids) == self.k:
            use &= scores >= self.scores[-1]
        if not use.any():
            return
        scores, ids = np.append(self.scores, scores[use]), np.append(self.ids, ids[use])
        if len(ids) > 8 * self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        top = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[top], ids[top]


def search(
    index: list[Bucket], ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, goals: list[list[Goal]],
    same_label: bool,
) -> int:
    """Fill the goals of each anchor; returns how many rows were scored, over all anchors."""
    exact = vectors.astype(np.float64)
    lengths = np.sqrt((exact ** 2).sum(axis=1))
    unit = exact / np.maximum(lengths, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    scored = 0
    for bucket in index:
        found: list[tuple[int, np.ndarray | None]] = []
        for q, wanted in enumerate(goals):
            needed = min((g.needed for g in wanted), default=np.inf)
            if needed == np.inf:
                continue
            reach = lengths[q] * bucket.longest
            if needed > reach * (1 + 1e-9):
                continue
            cosine = min(needed / reach - 1e-9, 1.0) if reach > 0 else 0.0
            rows = bucket.candidates(focus[q], unit[q], cosine) if vectors.shape[1] else None
            if rows is None or len(rows):
                found.append((q, rows))
        every = np.array([q for q, rows in found if rows is None], np.int64)
        longest = lengths.max(initial=0.0)
        for a in range(0, len(every), 500):
            part = every[a:a + 500]
            table = bucket.scores(slice(None), vectors[part], longest)
            scored += table.size
            for column, q in enumerate(part.tolist()):
                _offer(bucket, slice(None), table[:, column], ids[q], labels[q], goals[q], same_label)
        for q, rows in found:
            if rows is not None:
                scored += len(rows)
                _offer(bucket, rows, bucket.scores(rows, vectors[q:q + 1], longest)[:, 0], ids[q], labels[q],
                       goals[q], same_label)
    return scored


def _offer(bucket, rows, scores, own, label, goals, same_label) -> None:
    ids, labels = bucket.ids[rows], bucket.labels[rows]
    use = scores >= min(g.needed for g in goals)
    use &= ((labels == label) & (ids != own)) if same_label else labels != label
    if use.any():
        scores, ids = scores[use], ids[use]
        for goal in goals:
            goal.offer(scores, ids)


def within(score: int, low: int, high: int) -> tuple[int, int]:
    """Integer scores s with low * score <= 100 * s <= high * score."""
    return -(-int(score) * low // 100), int(score) * high // 100


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in vectors])


_FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def _cell(low: int, high: int, k: int, own_label: bool):
    def rows(anchors: pd.DataFrame, goals: list[list[Goal]]) -> Iterator[tuple]:
        for anchor, wanted, positives in zip(anchors["id"], goals, anchors["positives"]):
            for goal, positive in zip(wanted, positives):
                for i, s in zip(goal.ids.tolist(), goal.scores.tolist()):
                    yield anchor, positive["id"], positive["score"], i, s

    def cell(anchors: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        if anchors.empty or mine.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        index = buckets(mine["id"].to_numpy(), mine["label"].to_numpy(), _stack(mine["vector"]))
        goals = [[Goal(k) if own_label else Goal(k, *within(p["score"], low, high)) for p in positives]
                 for positives in anchors["positives"]]
        search(index, anchors["id"].to_numpy(), anchors["label"].to_numpy(), _stack(anchors["vector"]), goals, own_label)
        return pd.DataFrame(list(rows(anchors, goals)), columns=names).astype("int64")

    return cell


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _part(n: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")


def _parts(count: Column, size: int) -> Column:
    return F.ceil(count / size).cast("int")


_ROW = ["id", "label", "vector"]


def _cells(anchors: DataFrame, rows: DataFrame, keys: list[str], cell) -> DataFrame:
    keys = [*keys, "block", "shard"]
    anchors = anchors.toDF(*anchors.columns)  # Both sides come from one table; these are columns of its own.
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(cell, _FOUND)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, vector) with components floor(scale * x), of rows that take part."""
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(
        "id", "label", F.col("vector").cast("array<double>").alias("vector")).where(~wrong)
    return good.select("id", "label", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))


def _measured(rows: DataFrame) -> DataFrame:
    """One row for each id, with its dimension, squared length and length band."""
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return one.select(*_ROW, F.size("vector").alias("dim"), square.alias("square")).where(
        F.col("square") < float(1 << 63)).withColumn(
        "band", F.when(F.col("square") > 0, F.floor(F.log2("square"))).otherwise(-1).cast("int"))


def positives_of(rows: DataFrame, is_anchor: Column, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, found_id, score, rank): the k best rows of each anchor's own label.

    ``rows``: as ``_measured``. Cells hold rows of one label, which may have many cells.
    """
    sizes = write_and_reread(rows.groupBy("dim", "label").agg(
        _parts(F.count("*"), SHARD).alias("shards"), _parts(F.count_if(is_anchor), BLOCK).alias("blocks"),
    ).where("blocks > 0"))
    own = rows.select("dim", *_ROW).join(sizes, ["dim", "label"])
    one_goal = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")))
    asked = own.where(is_anchor).select(
        "dim", *_ROW, one_goal.alias("positives"), _part("blocks").alias("block"), _every("shards").alias("shard"))
    dealt = own.select("dim", *_ROW, _part("shards").alias("shard"), _every("blocks").alias("block"))
    found = _cells(asked, dealt, ["dim", "label"], _cell(LOW, HIGH, k, True))
    return _best(found, ["anchor_id"], k).select("anchor_id", "found_id", "score", "rank")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: (id long, label, vector array<long>); ``is_anchor`` is on ``id``.
    """
    rows = write_and_reread(_measured(rows))
    best = write_and_reread(positives_of(rows, is_anchor, positives))
    sought = best.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("found_id").alias("id"), "score"))).alias("positives"),
        F.min("score").alias("least"))
    blocks = rows.where(is_anchor).groupBy("dim").agg(_parts(F.count("*"), BLOCK).alias("blocks"))
    bands = write_and_reread(rows.groupBy("dim", "band").agg(
        _parts(F.count("*"), SHARD).alias("shards"), F.max("square").alias("longest")).join(blocks, "dim"))
    reach = F.sqrt("square") * F.sqrt("longest") * (1 + 1e-9)
    asked = rows.where(is_anchor).drop("band").join(sought, "id").join(bands, "dim").where(
        F.col("least") * (low / 100) <= reach).select(
        "dim", "band", *_ROW, "positives", _part("blocks").alias("block"), _every("shards").alias("shard"))
    dealt = rows.join(bands, ["dim", "band"]).select(
        "dim", "band", *_ROW, _part("shards").alias("shard"), _every("blocks").alias("block"))
    found = _cells(asked, dealt, ["dim", "band"], _cell(low, high, negatives, False))
    return _best(found, ["anchor_id", "positive_id", "positive_score"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
