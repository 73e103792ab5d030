"""Repeated windows of symbols, found level by level with growing lengths.

Two filters come first. Level 1 looks at *seeds*: the anchors of
``tickloom.llm.anchors``. A seed that occurs once in the corpus is dropped with
all its windows; for most text this ends here, after one small row for each
anchor. What is left is looked at in *blocks*, whole runs of windows with one
anchor: all windows of a block are settled at once where the same block starts
earlier. Only blocks that come first but share their seed with another block go
on. At level 2 they are cut into runs of a few windows, which have nearly a
whole window in common, their *core*; runs are settled in the same way.

What is still open is ranked by prefix doubling: positions have the rank of a
quarter of a window, pairs (rank, rank at an offset) are brought together and
ranked as the substring of twice the length, positions with a rank of their own
are dropped, until the ranks are those of whole windows.

A rank is a 64-bit hash and always stands in a key together with another one,
so that 128 bits decide.

Rows of one group are only ever counted, or reduced to their least place:
Spark combines them before the shuffle, and joins that look a group up can be
split where it is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.anchors import BASE, PIECE, U64, Blocks, Rolling, blocks, mix
from tickloom.llm.texts import Piece, in_small_batches, pieces, unused
from tickloom.session import discard, write_and_reread

#: Codes of the symbols of a piece, and the first symbol of each text.
Symbols = Callable[[Piece], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Ladder:
    symbols: Symbols
    window: int
    seed: int

    @property
    def run(self) -> int:
        """Windows of a run at level 2."""
        return max(1, (self.window - self.seed) // 8)

    @property
    def lengths(self) -> list[int]:
        """Lengths that are ranked: a quarter, a half, a whole window, rounded up."""
        return [-(-self.window // 4), -(-self.window // 2), self.window]

    @property
    def offsets(self) -> list[int]:
        """From one length to the next: where the second part starts."""
        return [b - a for a, b in zip(self.lengths, self.lengths[1:])]


def all_blocks(ladder: Ladder, codes: np.ndarray, bounds: np.ndarray) -> Blocks:
    """Blocks of any number of symbols; long texts are taken in slices."""
    if len(codes) <= PIECE + ladder.window:
        return blocks(codes, bounds, ladder.window, ladder.seed)
    parts = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        for s in range(a, max(b - ladder.window + 1, a), PIECE):
            e = min(s + PIECE + ladder.window - 1, b)
            part = blocks(codes[s:e], np.array([0, e - s]), ladder.window, ladder.seed)
            parts.append(part._replace(anchor=part.anchor + s, first=part.first + s))
    if not parts:
        return blocks(codes[:0], np.zeros(1, np.int64), ladder.window, ladder.seed)
    return Blocks(*(np.concatenate(x) for x in zip(*parts)))


def first_in_text(found: Blocks, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each block, and the number of the first equal block in that text."""
    text = np.searchsorted(bounds, found.first, side="right") - 1
    key = mix(mix(found.seed.view(U64)) + found.body.view(U64) * U64(BASE) + text.astype(U64))
    _, at, back = np.unique(key, return_index=True, return_inverse=True)
    return text, at[back]


def _arrow(*columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for _, v in columns], [k for k, _ in columns])


class Places:
    """A run of windows as one number: first window, distance to the anchor, count.

    The numbers order as the first windows do.
    """

    def __init__(self, ladder: Ladder):
        self._unit = ladder.window + 1

    def pack(self, lo, lead, n) -> np.ndarray:
        return (lo * self._unit + lead) * self._unit + n

    def unpack(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, n = np.divmod(place, self._unit)
        lo, lead = np.divmod(rest, self._unit)
        return lo, lead, n


def _scan(ladder: Ladder, seeds_only: bool):
    places = Places(ladder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "copy"))
            for piece in pieces(batch.column("text")):
                codes, bounds = ladder.symbols(piece)
                found = all_blocks(ladder, codes, bounds)
                text, first = first_in_text(found, bounds)
                own = np.flatnonzero(first == np.arange(len(first)))
                if seeds_only:
                    yield _arrow(("outer", found.seed[own]))
                    continue
                lo, text = found.first[own], text[own]
                yield _arrow(
                    ("outer", found.seed[own]), ("inner", found.body[own]),
                    ("doc_id", ids[piece.begin + text].astype(np.int64)),
                    ("copy", copies[piece.begin + text]),
                    ("place", places.pack(
                        lo - bounds[text], found.anchor[own] - lo, found.count[own])),
                )

    return run


def listed(batch: pa.RecordBatch, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The places of the piece's texts (the batch's last column), and which text each belongs to."""
    lists = batch.column(batch.num_columns - 1).slice(piece.begin, piece.end - piece.begin)
    size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _runs(ladder: Ladder):
    """Ranks of the runs of blocks."""
    places, window, run = Places(ladder), ladder.window, ladder.run

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "copy"))
            for piece in pieces(batch.column("text"), PIECE // 2):
                codes, bounds = ladder.symbols(piece)
                rolling = Rolling(codes)
                place, text = listed(batch, piece)
                for a in range(0, len(place), 20_000):
                    part = slice(a, a + 20_000)
                    yield level(rolling, ids[piece.begin:], copies[piece.begin:], bounds, place[part], text[part])

    def level(rolling, ids, copies, bounds, place, text):
        lo, lead, n = places.unpack(place)
        # A run holds the windows of one multiple of the distance to the anchor.
        top, low = lead // run, (lead - n + 1) // run
        count = top - low + 1
        skip = np.maximum(np.repeat(lead + 1, count)
                          - run * (np.repeat(top + 1, count) - _ranges(0 * top, count)), 0)
        lo, lead, n, text = (np.repeat(x, count) for x in (lo, lead, n, text))
        at, lead = bounds[text] + lo + skip, lead - skip
        n = np.minimum(lead % run + 1, n - skip)
        s = at + lead
        seed = mix(rolling.of(s, s + ladder.seed))
        first = s - lead // run * run
        core = mix(seed + rolling.of(first, first + window - run + 1) * U64(BASE))
        body = rolling.of(at, at + window + n - 1)
        return _arrow(
            ("outer", core.view(np.int64)),
            ("inner", mix(body + (lead * window + n).astype(U64) * U64(BASE)).view(np.int64)),
            ("doc_id", ids[text].astype(np.int64)), ("copy", copies[text]),
            ("place", places.pack(lo + skip, lead, n)))

    return ranks


def _first_pairs(ladder: Ladder):
    """Pairs of ranks of the shortest length, where the windows of runs need the next one."""
    places, length, offset = Places(ladder), ladder.lengths[0], ladder.offsets[0]
    parts = [0]
    for later in ladder.offsets[1:]:
        parts = sorted({p + o for p in parts for o in (0, later)})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "copy"))
            for piece in pieces(batch.column("text"), PIECE // 2):
                codes, bounds = ladder.symbols(piece)
                place, text = listed(batch, piece)
                lo, _, n = places.unpack(place)
                windows = _ranges(bounds[text] + lo, n)
                wanted = np.zeros(len(codes) + 1, bool)
                for part in parts:
                    wanted[windows + part] = True
                at = np.flatnonzero(wanted)
                text = np.searchsorted(bounds, at, side="right") - 1
                rolling = Rolling(codes)
                low, high = (mix(rolling.of(x, x + length)).view(np.int64) for x in (at, at + offset))
                yield _arrow(
                    ("doc_id", ids[piece.begin + text].astype(np.int64)), ("copy", copies[piece.begin + text]),
                    ("at", at - bounds[text]), ("low", low), ("high", high))

    return pairs


PAIRS = "doc_id long, copy long, at long, low long, high long"


def _pairs(points: DataFrame, offset: int) -> DataFrame:
    """(doc_id, copy, at, low, high): positions that have a rank, and one ``offset`` further on."""
    none = F.lit(None).cast("long")
    here = points.select("doc_id", "copy", "at", F.col("rank").alias("low"), none.alias("high"))
    there = points.select("doc_id", "copy", F.col("at") - offset, none, "rank").where(F.col("at") >= offset)
    return here.union(there).groupBy("doc_id", "copy", "at").agg(
        F.max("low").alias("low"), F.max("high").alias("high")).where("low IS NOT NULL AND high IS NOT NULL")


def _reranked(pairs: DataFrame) -> DataFrame:
    """Positions with the rank of the pair, without those that have one of their own."""
    pairs = write_and_reread(pairs)
    several = write_and_reread(pairs.groupBy("low", "high").count().where("count > 1").select("low", "high"))
    points = write_and_reread(pairs.join(several, ["low", "high"], "left_semi").select(
        "doc_id", "copy", "at", F.xxhash64("low", "high").alias("rank")))
    discard(pairs, several)
    return points


def copy_of() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64("text")


def with_places(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` and, in a last column, the places that ``rows`` names in each text; no more
    than it has windows. Rows that share a doc_id have their own places."""
    names = [unused(docs, c) for c in ("_doc", "_copy", "_places")]
    by_text = rows.groupBy("doc_id", "copy").agg(F.collect_list("place")).toDF(*names)
    same = (F.col("doc_id") == F.col(names[0])) & (copy_of() == F.col(names[1]))
    return docs.join(by_text, same, how).drop(*names[:2])


ROWS = "outer long, inner long, doc_id long, copy long, place long"


def _place(within_texts: bool) -> Column:
    return F.struct("doc_id", "place") if within_texts else F.col("doc_id")


def _repeated(rows: DataFrame, within_texts: bool) -> DataFrame:
    """Places of rows with an earlier equal one."""
    me = _place(within_texts)
    classes = write_and_reread(rows.groupBy("outer", "inner").agg(
        F.min(me).alias("first"), F.max(me).alias("last")).where("first < last").drop("last"))
    found = write_and_reread(rows.join(classes, ["outer", "inner"]).where(me > F.col("first")).select(
        "doc_id", "copy", "place"))
    discard(rows, classes)
    return found


def _judged(rows: DataFrame, within_texts: bool) -> DataFrame:
    """Rows with an earlier equal one (``covered``) and first rows that share ``outer``."""
    me = _place(within_texts)
    classes = write_and_reread(rows.groupBy("outer", "inner").agg(F.min(me).alias("first")))
    # Stored, so that the join with it can be split where one rank has very many classes.
    several = write_and_reread(classes.groupBy("outer").count().where("count > 1").select("outer"))
    shared = several.withColumn("shared", F.lit(True))
    judged = write_and_reread(
        rows.join(classes.join(shared, "outer", "left"), ["outer", "inner"])
        .select("doc_id", "copy", "place", (me > F.col("first")).alias("covered"),
                F.col("shared").isNotNull().alias("shared"))
        .where("covered OR shared"))
    discard(rows, classes, several)
    return judged


def repeated_windows(docs: DataFrame, ladder: Ladder, within_texts: bool) -> DataFrame:
    """Places (doc_id, copy, place) of windows that also start earlier.

    Earlier is a smaller ``doc_id``; with ``within_texts`` also an earlier start
    in the same text. Equal blocks of one text are given once, by the first:
    what is said of it holds for the others (see ``removed_windows``).
    """
    in_small_batches(docs)
    base = docs.select("doc_id", "text", copy_of().alias("copy")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    seeds = write_and_reread(
        base.mapInArrow(_scan(ladder, True), "outer long")
        .groupBy("outer").count().where("count > 1").select("outer"))
    blocks_ = write_and_reread(
        base.mapInArrow(_scan(ladder, False), ROWS).join(seeds, "outer", "left_semi"))
    # Equal blocks of one text are one row here, so the least doc_id is enough.
    places = ["doc_id", "copy", "place"]
    by_block = _judged(blocks_, False)
    discard(seeds)
    runs = write_and_reread(with_places(base, by_block.where("NOT covered").select(places)).mapInArrow(
        _runs(ladder), ROWS))
    by_run = _judged(runs, within_texts)
    # The first pairs of a text are made where it is read, later ones by Spark.
    points = _reranked(with_places(base, by_run.where("NOT covered").select(places)).mapInArrow(
        _first_pairs(ladder), PAIRS))
    for offset in ladder.offsets[1:-1]:
        points = _reranked(_pairs(points, offset))
    unit = ladder.window + 1
    one = ((F.col("at") * unit) * unit + 1).alias("place")  # As ``Places`` has it: a run of one window.
    windows = write_and_reread(_pairs(points, ladder.offsets[-1]).select(
        F.col("low").alias("outer"), F.col("high").alias("inner"), "doc_id", "copy", one))
    discard(points)
    by_rank = _repeated(windows, within_texts)
    return by_block.where("covered").select(places).unionByName(
        by_run.where("covered").select(places)).unionByName(by_rank)


def removed_windows(
    ladder: Ladder, codes: np.ndarray, bounds: np.ndarray,
    place: np.ndarray, text: np.ndarray, within_texts: bool,
) -> np.ndarray:
    """For each symbol of the piece, whether a window that starts there is repeated."""
    lo, _, n = Places(ladder).unpack(place)
    step = np.zeros(len(codes) + 1, np.int64)
    first = np.minimum(bounds[text] + lo, bounds[text + 1])
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + n, bounds[text + 1]), -1)
    marked = np.cumsum(step[:-1]) > 0
    found = all_blocks(ladder, codes, bounds)
    _, origin = first_in_text(found, bounds)
    again = np.flatnonzero(origin != np.arange(len(origin)))
    if not len(again):
        return marked
    count = found.count[again]
    to = _ranges(found.first[again], count)
    if within_texts:
        marked[to] = True
    else:
        marked[to] = marked[_ranges(found.first[origin[again]], count)]
    return marked


def covered_symbols(
    marked: np.ndarray, bounds: np.ndarray, window: int,
) -> np.ndarray:
    """Symbols that some marked window covers. A window never crosses texts."""
    step = np.zeros(len(marked) + 1, np.int64)
    at = np.flatnonzero(marked)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + window, len(marked)), -1)
    return np.cumsum(step[:-1]) > 0


def rewritten(batch: pa.RecordBatch, piece: Piece, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of the piece with new texts, without the last column; ``n_chars``, if there, follows
    the texts."""
    out, names = [], batch.schema.names[:-1]
    for name in names:
        if name == "text":
            out.append(pa.array(texts, pa.string()))
        elif name == "n_chars":
            out.append(pa.array([None if x is None else len(x) for x in texts],
                                batch.schema.field(name).type))
        else:
            out.append(batch.column(name).slice(piece.begin, piece.end - piece.begin))
    return pa.RecordBatch.from_arrays(out, names)
