"""Substring de-duplication by words: repeated passages of 50 words are cut.

Level-wise doubling over the positions that two filters leave (see
``repeats``): strings of 13 words that repeat are extended to 25, those that
still repeat to 50, and the others are dropped at each level. The filters
settle whole blocks and runs of windows by one hash, and lose no repeat.

Results for unusual rows: NULL and empty texts have no words. A row with NULL
doc_id is returned whole and is no earlier occurrence for others. Rows that
share a doc_id are one document of several texts, never earlier than each other. Repeats inside
one document stay. Texts under 50 words stay whole. Other columns are carried
by ``dedup``, under any name, and ignored by ``cuts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.repeats import (
    Ladder, covered_symbols, listed, removed_windows, repeated_windows, rewritten, with_places,
)
from tickloom.llm.texts import Piece, pieces, word_hashes, words

WINDOW = 50
SEED = 12

CUTS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _words(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    found = words(piece)
    return word_hashes(piece.data, found), found.bounds


def ladder(window: int = WINDOW, seed: int = SEED) -> Ladder:
    return Ladder(_words, window, min(seed, window))


def _joined(piece: Piece, start: np.ndarray, end: np.ndarray) -> bytes:
    data = piece.data
    return b" ".join(data[a:b].tobytes() for a, b in zip(start, end))


def _cut(steps: Ladder, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                found = words(piece)
                codes, bounds = word_hashes(piece.data, found), found.bounds
                place, text = listed(batch, piece)
                marked = removed_windows(steps, codes, bounds, place, text, False)
                keep = ~covered_symbols(marked, bounds, steps.window)
                kept = [_joined(piece, found.start[a:b][keep[a:b]], found.end[a:b][keep[a:b]])
                        for a, b in zip(bounds[:-1], bounds[1:])]
                n = np.diff(bounds)
                if texts:
                    whole = [bool(keep[a:b].all()) for a, b in zip(bounds[:-1], bounds[1:])]
                    old = batch.column("text").slice(piece.begin, len(n)).to_pylist()
                    yield rewritten(batch, piece, [
                        o if w else x.decode() for o, w, x in zip(old, whole, kept)])
                    continue
                left = np.add.reduceat(np.append(keep, 0).astype(np.int64), bounds[:-1]) * (n > 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(piece.begin, len(n)),
                    pa.array(n), pa.array(n - left),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def cuts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What is cut from each document: one row each, columns as in ``CUTS``."""
    steps = ladder(window)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = repeated_windows(docs, steps, within_texts=False)
    return with_places(docs, found, "left").mapInArrow(_cut(steps, False), CUTS)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with passages cut, all other columns kept.

    A text that loses words is its kept words joined by one space; others stay
    as they are. ``n_chars``, if there, follows the text.
    """
    steps = ladder(window)
    found = repeated_windows(docs, steps, within_texts=False)
    return with_places(docs, found, "left").mapInArrow(
        _cut(steps, True), docs.schema)
