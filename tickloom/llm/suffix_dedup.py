"""Suffix-array de-duplication: bytes of repeated 100-byte strings are cut.

Prefix doubling over the positions that two filters leave (see ``repeats``): a
position has the rank of its 25 bytes; Spark brings (rank, rank at an offset)
pairs together, ranks them as 50 and then 100 bytes, and drops positions whose
rank has become unique. The filters settle whole blocks and runs of windows by
one hash; without them every byte's position would be shuffled several times.

Results for unusual rows: NULL text counts as empty. A row with NULL doc_id is
returned; only repeats inside its own text are cut, and it is no earlier
occurrence for others. Rows that share a doc_id are one document
of several texts: places count from the start of each, and what stands at the same
place of two is no earlier occurrence. Texts under 100 bytes
are kept whole. Other columns are carried by ``dedup``, under any
name, and ignored by ``cuts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.anchors import byte_codes
from tickloom.llm.repeats import (
    Ladder, covered_symbols, listed, removed_windows, repeated_windows, rewritten,
    with_places,
)
from tickloom.llm.texts import Piece, pieces

THRESHOLD = 100
SEED = 24


def _bytes(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    return byte_codes()[piece.data], piece.bounds


def ladder(threshold: int = THRESHOLD, seed: int = SEED) -> Ladder:
    return Ladder(_bytes, threshold, min(seed, threshold))


CUTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(steps: Ladder, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                codes, bounds = steps.symbols(piece)
                place, text = listed(batch, piece)
                marked = removed_windows(steps, codes, bounds, place, text, True)
                gone = covered_symbols(marked, bounds, steps.window)
                spans = list(zip(bounds[:-1], bounds[1:]))
                kept = [piece.data[a:b][~gone[a:b]].tobytes() for a, b in spans]
                if texts:
                    # A cut can fall inside a character; what is left of it goes too.
                    yield rewritten(batch, piece, [x.decode("utf-8", "ignore") for x in kept])
                    continue
                size = np.diff(bounds)
                runs = [np.count_nonzero(np.diff(gone[a:b].astype(np.int8), prepend=0) == 1)
                        for a, b in spans]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(piece.begin, piece.end - piece.begin),
                    pa.array(size), pa.array(size - np.array([len(x) for x in kept])),
                    pa.array(runs, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def cuts(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """What is cut from each document: one row each, columns as in ``CUTS``."""
    steps = ladder(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = repeated_windows(docs, steps, within_texts=True)
    return with_places(docs, found, "left").mapInArrow(_cut(steps, False), CUTS)


def dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with cut texts, all other columns kept; NULL texts become empty.

    The rest of a character that was cut in two is dropped. ``n_chars``, if
    there, follows the text. Documents of which nothing is left stay, empty.
    """
    steps = ladder(threshold)
    found = repeated_windows(docs, steps, within_texts=True)
    return with_places(docs, found, "left").mapInArrow(
        _cut(steps, True), docs.schema)
