"""Approximate nearest neighbours: vantage-point trees, one in each shard.

Nearness is the largest inner product. With one coordinate more, which lifts
every vector to the length of the longest, it becomes the least Euclidean
distance, for which the triangle inequality holds. A shard is cut into bands of
vectors of similar length, each with a tree and a longest of its own, and queries
are brought to that length, so that the lift does not make all distances alike.
A tree splits its vectors by their distance to a vantage point; a branch whose
vectors cannot be nearer than the k-th best found so far is not entered.
``factor`` relaxes this once a query has k candidates: a branch is left out if even
its bound exceeds ``factor`` times that distance. Queries that lie outside all
vectors of a node see them at much the same distance; their search in it stays
exact. Factor one gives exact search, smaller ones leave out more.

Equal vectors are one point of the trees, with their k + 1 least ids, which is
all that can be wanted of them; batches reduce them before the shuffle. Points
are dealt to shards, queries to blocks, by a hash; a task searches one block in
one shard, both of bounded size. Only sizes and a sample of bounded size, which
gives first bounds, pass through the driver.

Results for unusual rows: vectors that are NULL, zero, or hold NULL or
non-finite components take no part, nor do those of another dimension than most
(of dimensions equally common the larger counts), nor rows with NULL id. Rows
that repeat an id with an equal vector are one row; with another vector they are
rows of their own. A query never finds its own id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import write_and_reread

NEIGHBOURS = 20
FACTOR = 0.6
SHARD, BLOCK, SAMPLE, LEAF = 20_000, 10_000, 2_000, 128
#: Points ranked beyond those wanted, before scores are made exact.
SPARE = 8
#: Greatest quotient of two lengths in a band.
BAND = 2.0


@dataclass
class _Node:
    vantage: np.ndarray
    near: tuple[float, float]  # least and greatest distance of the branches' points
    far: tuple[float, float]
    inside: "_Node | np.ndarray"
    outside: "_Node | np.ndarray"


def build(points: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> _Node | np.ndarray:
    """A tree over rows of ``points``; its leaves are arrays of row numbers."""

    def split(rows: np.ndarray) -> _Node | np.ndarray:
        if len(rows) <= leaf:
            return rows
        vantage = points[rows[rng.integers(len(rows))]]
        away = np.sqrt(np.maximum(((points[rows] - vantage) ** 2).sum(axis=1), 0))
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        a, b = order[:half], order[half:]
        return _Node(vantage, (away[a].min(), away[a].max()), (away[b].min(), away[b].max()),
                     split(rows[a]), split(rows[b]))

    return split(np.arange(len(points)))


def search(
    tree: _Node | np.ndarray, points: np.ndarray, queries: np.ndarray, worst: np.ndarray,
    k: int, factor: float, full: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of the k nearest points of each query.

    ``worst``: a distance that the k-th nearest is known not to exceed. ``full``:
    queries that have k candidates already. Missing neighbours have row -1.
    """
    rows = np.full((len(queries), k), -1)
    best = np.full((len(queries), k), np.inf)
    worst = worst.copy()
    full = np.zeros(len(queries), bool) if full is None else full.copy()
    square = (queries ** 2).sum(axis=1)
    todo = [(tree, np.arange(len(queries)), np.zeros(len(queries)), np.zeros(len(queries)))]
    while todo:
        # ``least``: no point of the node's parents is nearer.
        node, who, bound, least = todo.pop()
        part = np.where(full[who] & (least == 0), factor, 1)
        live = bound <= part * worst[who] * (1 + 1e-12) + 1e-7
        who, least = who[live], least[live]
        if not len(who):
            continue
        if isinstance(node, np.ndarray):
            part = points[node]
            away = square[who, None] + (part ** 2).sum(axis=1) - 2 * queries[who] @ part.T
            away = np.concatenate([best[who], away], axis=1)
            names = np.concatenate([rows[who], np.broadcast_to(node, (len(who), len(node)))], axis=1)
            pick = np.argpartition(away, k - 1, axis=1)[:, :k]
            best[who] = np.take_along_axis(away, pick, axis=1)
            rows[who] = np.take_along_axis(names, pick, axis=1)
            worst[who] = np.minimum(worst[who], np.sqrt(np.maximum(best[who].max(axis=1), 0)))
            full[who] |= (rows[who] >= 0).all(axis=1)
            continue
        to = np.sqrt(np.maximum(square[who] + (node.vantage ** 2).sum() - 2 * queries[who] @ node.vantage, 0))
        low = [np.maximum(np.maximum(to - high, short - to), 0) for short, high in (node.near, node.far)]
        inner = low[0] <= low[1]
        least = np.maximum(least, np.minimum(*low))
        # The nearer branch of each query comes off the stack first.
        for child, other, mine in ((node.inside, low[0], ~inner), (node.outside, low[1], inner),
                                   (node.inside, low[0], inner), (node.outside, low[1], ~inner)):
            if mine.any():
                todo.append((child, who[mine], other[mine], least[mine]))
    return rows, best


def _lengths(points: np.ndarray) -> np.ndarray:
    most = np.abs(points).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((points / most) ** 2).sum(axis=1))


def bands(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of similar length, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    falling = -lengths[order]
    at = 0
    while at < len(order):
        end = max(int(np.searchsorted(falling, falling[at] / BAND, side="right")), at + 1)
        yield order[at:end]
        at = end


def search_bands(
    points: np.ndarray, queries: np.ndarray, sample: np.ndarray, k: int, factor: float,
) -> np.ndarray:
    """Rows of the k points with the largest inner products; missing ones are -1.

    ``sample``: points of the whole table; what cannot be as good as the k-th
    best of them may be left out.
    """
    one = queries / _lengths(queries)[:, None]
    rows = np.full((len(queries), k), -1)
    value = np.full((len(queries), k), -np.inf)
    sure = np.full(len(queries), -np.inf)
    if len(sample) >= k:
        sure = np.partition(one @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k]
    to = np.concatenate([one, np.zeros((len(one), 1))], axis=1)
    lengths = _lengths(points)
    for band in bands(lengths):
        longest = lengths[band[0]]
        least = np.maximum(sure, value.min(axis=1))
        who = np.flatnonzero(least <= longest * (1 + 1e-9))  # no product exceeds the lengths'
        if not len(who):
            break
        high = _lift(points[band] / longest)
        with np.errstate(over="ignore"):
            worst = np.sqrt(np.maximum(2 - 2 * (least[who] / longest), 0))
        found, away = search(build(high, np.random.default_rng(len(band))), high, to[who], worst, k, factor,
                             np.isfinite(value[who]).all(axis=1))
        both = np.concatenate([value[who], (1 - away / 2) * longest], axis=1)
        names = np.concatenate([rows[who], np.where(found >= 0, band[found], -1)], axis=1)
        pick = np.argpartition(-both, k - 1, axis=1)[:, :k]
        value[who] = np.take_along_axis(both, pick, axis=1)
        rows[who] = np.take_along_axis(names, pick, axis=1)
    return rows


def _exact(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, each summed up in the same order wherever it is computed."""
    return (points * query).sum(axis=1)


def _least_ids(k: int):
    """Equal vectors of a batch with their k least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            frame["vector"] = [np.asarray(v, np.float64).tobytes() for v in frame["vector"]]
            frame = frame.drop_duplicates().sort_values("id", kind="stable")
            frame = frame[frame.groupby("vector").cumcount() < k]
            yield pa.RecordBatch.from_pandas(frame[["vector", "id"]], preserve_index=False)

    return run


def _valid(vectors: DataFrame) -> DataFrame:
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~wrong & some)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, factor: float = FACTOR,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (id, vector); ``is_query`` is on ``id``."""
    spark = vectors.sparkSession
    vectors = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    good = _valid(vectors)
    sizes = good.groupBy(F.size("vector").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("asked"),
    ).orderBy(F.desc("n"), F.desc("dim")).first()
    found = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], found).selectExpr(
            "query_id", "CAST(1 AS INT) AS rank", "vec_id", "score")
    good = good.where(F.size("vector") == sizes["dim"])
    in_class = Window.partitionBy("vector").orderBy("id")
    points = write_and_reread(
        good.mapInArrow(_least_ids(k + 1), "vector binary, id long").distinct()
        .withColumn("n", F.row_number().over(in_class)).where(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = -(-points.count() // SHARD)
    blocks = max(1, -(-sizes["asked"] // BLOCK))
    sample = _matrix(points.orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()["vector"])

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    queries = good.where(is_query).select("id", "vector").distinct().select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"),
        "id", "vector")
    dealt = points.select(
        every(blocks).alias("block"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"),
        "vector", "ids")

    def cell(asked: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                            "score": pd.Series(dtype="float64")})
        if asked.empty or mine.empty:
            return out
        raw = _matrix(mine["vector"])
        own = np.stack(asked["vector"].to_numpy()).astype(np.float64)
        want = min(k + 1 + SPARE, len(raw))
        rows = search_bands(raw, own, sample, want, factor)
        ids = mine["ids"].to_numpy()
        frames = []
        for q, query, found_rows in zip(asked["id"], own, rows):
            found_rows = found_rows[found_rows >= 0]
            score = _exact(query, raw[found_rows])
            names = [ids[r] for r in found_rows]
            vec = np.concatenate(names) if names else np.zeros(0, np.int64)
            value = np.repeat(score, [len(x) for x in names])
            value, vec = value[vec != q], vec[vec != q]
            top = np.lexsort((vec, -value))[:k]
            frames.append(pd.DataFrame({"query_id": q, "vec_id": vec[top], "score": value[top]}))
        return pd.concat(frames) if frames else out

    hits = queries.groupBy("block", "shard").cogroup(
        dealt.groupBy("block", "shard")).applyInPandas(cell, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # An id may stand for several vectors; its best counts.
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lift(points: np.ndarray) -> np.ndarray:
    """One coordinate more, so that all have length one."""
    rest = np.sqrt(np.maximum(1 - (points ** 2).sum(axis=1), 0))
    return np.concatenate([points, rest[:, None]], axis=1)
