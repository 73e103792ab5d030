"""Periodic runs: stretches of words that repeat with a small period.

A run is a stretch whose words recur at a distance of its smallest period, long
against that period, and which neither neighbour continues. Runs are found by
Kruskal's order over suffixes: the suffixes of a text that share a beginning are
united by decreasing length of what they share (LCP); each class is the ordered
set of its positions. Where a union makes two positions neighbours whose distance
d is within their LCP, the words from the first one on repeat with period d, for
d + LCP words; if the word before does not fit as well, they are a run. Two
positions of a run one period apart are neighbours when they meet, since any
position between them would give the run a smaller period, so no run is missed.

Spark deals the texts out; there is nothing to shuffle, as runs do not cross texts.
In a task, the words of the texts of about 256 KB, or of one longer text, are
ranked together by prefix doubling over numpy arrays. Positions that have become
unique are left out, so that in prose hardly any reaches the unions, which take
the smaller set into the larger one.

Results for unusual rows: NULL, empty and blank texts have no words and no runs.
A NULL doc_id is carried like any other; rows that share one are texts of their
own. A text of any length is looked at whole: a task holds four bytes for each of its
words and each doubling of the longest repeat in it. Empty tables give no rows.
Other columns are ignored by ``runs`` and carried by ``collapsed``, under any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.anchors import U64
from tickloom.llm.texts import in_small_batches, pieces, word_hashes, words

#: Words of a run at least, and how many times its period it is long at least.
LEAST_WORDS, EXPONENT = 6, 4

RUNS = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
        "kept string")


class Runs(NamedTuple):
    text: np.ndarray
    start: np.ndarray   # word number in the text
    length: np.ndarray
    period: np.ndarray


def least_depth(least: int, exponent: int) -> int:
    """The least LCP that two positions of a run, one period apart, can have."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _ranked(codes: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, without those whose LCP with
    others is surely under ``depth``, and the ranks by 1, 2, 4, ... words.

    A rank is the number of positions in smaller classes, so that sorting
    the members of a class leaves all others as they are. What ends with its
    text comes before what goes on.
    """
    n = len(codes)
    end = np.repeat(bounds[1:], np.diff(bounds))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((codes, text))
    fresh = np.ones(n, bool)
    fresh[1:] = (codes[order[1:]] != codes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, length = [rank], 1
    open_ = order[~(fresh & np.append(fresh[1:], True))]
    long = open_
    while len(open_):
        second = np.full(len(open_), -1, np.int64)
        on = open_ + length < end[open_]
        second[on] = rank[open_[on] + length]
        key = rank[open_].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        at = np.arange(len(open_))
        fresh = np.ones(len(open_), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.ones(len(open_), bool)
        first[1:] = old[1:] != old[:-1]
        step = (np.maximum.accumulate(np.where(fresh, at, 0))
                - np.maximum.accumulate(np.where(first, at, 0)))
        rank = rank.copy()
        rank[open_] = old + step.astype(np.int32)
        levels.append(rank)
        length *= 2
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        if length <= depth:
            long = open_
    return long[np.argsort(rank[long], kind="stable")], levels


def _shared(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCPs of pairs of positions."""
    depth, last = np.zeros(len(a), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + depth, b + depth
        inside = (x <= last) & (y <= last)
        same = inside & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])
        depth[same] += 1 << k
    return depth


def _united(a: np.ndarray, b: np.ndarray, depth: np.ndarray, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(position, next position, LCP) where a union makes two positions neighbours
    that are close enough for a run."""
    sets: dict[int, list[int]] = {}
    near = exponent - 1
    for x, y, most in zip(a.tolist(), b.tolist(), depth.tolist()):
        into, other = sets.get(x) or [x], sets.get(y) or [y]
        if len(into) < len(other):
            into, other = other, into
        sets[into[0]] = into
        end = len(other) - 1
        for k, new in enumerate(other):
            at = bisect_left(into, new)
            # The one before may have come from the same set; then they were neighbours.
            if at and near * (new - into[at - 1]) <= most and not (k and other[k - 1] == into[at - 1]):
                yield into[at - 1], new, most
            if at < len(into):
                after = into[at]
                if near * (after - new) <= most and (k == end or other[k + 1] > after):
                    yield new, after, most
            into.insert(at, new)
            sets[new] = into


def find_runs(
    codes: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT,
) -> Runs:
    """Runs of the texts ``codes[bounds[i]:bounds[i + 1]]``, by text, start and period.

    ``exponent`` is at least 2: shorter repeats need not meet as neighbours.
    """
    if exponent < 2:
        raise ValueError("exponent must be 2 or more")
    least = max(least, exponent)
    depth = least_depth(least, exponent)
    none = np.zeros(0, np.int64)
    if not len(codes):
        return Runs(none, none, none, none)
    order, levels = _ranked(codes, bounds, depth)
    a, b = order[:-1], order[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    shared = _shared(a, b, levels)
    deep = shared >= depth
    a, b, shared = a[deep], b[deep], shared[deep]
    falling = np.argsort(-shared, kind="stable")
    seeds = np.array(list(_united(a[falling], b[falling], shared[falling], exponent)), np.int64).reshape(-1, 3)
    start, period = seeds[:, 0], seeds[:, 1] - seeds[:, 0]
    length = seeds[:, 2] + period
    text = np.searchsorted(bounds, start, side="right") - 1
    begins = start == bounds[text]
    begins |= codes[start - 1] != codes[start + period - 1]
    real = begins & (length >= np.maximum(least, exponent * period))
    text, start, length, period = (x[real] for x in (text, start - bounds[text], length, period))
    by = np.lexsort((period, start, text))
    return Runs(text[by], start[by], length[by], period[by])


def _stays(runs: Runs, bounds: np.ndarray) -> np.ndarray:
    """Words outside all runs, or in the first period of every run that holds them."""
    step = np.zeros(bounds[-1] + 1, np.int64)
    at = bounds[runs.text] + runs.start
    np.add.at(step, at + runs.period, 1)
    np.add.at(step, at + runs.length, -1)
    return np.cumsum(step[:-1]) == 0


def _scan(least: int, exponent: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                found = words(piece)
                codes, bounds = word_hashes(piece.data, found), found.bounds
                runs = find_runs(codes, bounds, least, exponent)
                stay = _stays(runs, bounds)
                n = len(bounds) - 1
                whole = np.bincount(runs.text, minlength=n) == 0
                kept = [None if texts and w else _joined(piece.data, found.start[a:b][stay[a:b]],
                                                         found.end[a:b][stay[a:b]])
                        for w, a, b in zip(whole, bounds[:-1], bounds[1:])]
                rows = batch.slice(piece.begin, n)
                if texts:
                    old = rows.column("text").to_pylist()
                    yield _with_texts(rows, [o if k is None else k for o, k in zip(old, kept)])
                    continue
                cut = np.searchsorted(runs.text, np.arange(n + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (runs.start, runs.length, runs.period)],
                    ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(bounds)), listed, pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "runs", "kept"])

    return run


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    raw = data.tobytes() if len(start) else b""
    return b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())]).decode()


def _with_texts(rows: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    columns = {"text": texts, "n_chars": [None if x is None else len(x) for x in texts]}
    return pa.RecordBatch.from_arrays([
        pa.array(columns[f.name], f.type) if f.name in columns else rows.column(i)
        for i, f in enumerate(rows.schema)], schema=rows.schema)


def runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, kept) of each of ``docs``: its runs by start, then period, and
    the words that are left if each run keeps its first period, joined by one space."""
    in_small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan(least, exponent, False), RUNS)


def collapsed(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with texts cut to the first period of every run, all columns kept.

    Texts without runs stay as they are. ``n_chars``, if there, follows the text.
    """
    in_small_batches(docs)
    return docs.mapInArrow(_scan(least, exponent, True), docs.schema)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by hash of doc_id, repeats a few of
    its words to its end; test material for the query, as prose has few runs."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", hashed.alias("h"),
        F.when(hashed % 10 == 0, F.regexp_extract_all("text", F.lit("([^ \\t-\\r]+)"), F.lit(1))).alias("w"))
    placed = plain.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn(
        "p", (1 + F.expr("(n - a) div (3 + g % 8)")).cast("int"))
    tail = F.expr("transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)])")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " "))
                         .otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row of figures and hashes for each row of ``runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.short")).alias("period"),
        F.expr("1000 * top.length div -top.short").cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
