"""Texts of Arrow batches as byte arrays, and their words.

Words are runs of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``). White space is one byte in UTF-8, so words are cut
on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.anchors import PIECE, U64, BASE, mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


#: Records and bytes of an Arrow batch; texts are long, and a batch is held whole
#: on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to small Arrow batches, for work on long texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all columns stand in ``row``, where none can clash with another."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
        F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Piece(NamedTuple):
    """Texts ``begin`` to ``end`` of a batch, laid end to end."""

    begin: int
    end: int
    data: np.ndarray    # bytes
    bounds: np.ndarray  # where each text starts, and the end of the last


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a column of texts; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """The column in runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    data, bounds = flat(column)
    begin, n = 0, len(bounds) - 1
    while begin < n:
        end = int(np.searchsorted(bounds, bounds[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), n)
        at = bounds[begin:end + 1]
        yield Piece(begin, end, data[at[0]:at[-1]], at - at[0])
        begin = end


class Words(NamedTuple):
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # byte after each word
    bounds: np.ndarray  # first word of each text, and the number of words


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def words(piece: Piece) -> Words:
    data, bounds = piece.data, piece.bounds
    ink = np.zeros(len(data) + 2, np.int8)
    ink[1:-1] = ~_SPACE[data]
    step = np.diff(ink)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A word that runs on into the next text is two words.
    inner = bounds[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[(ink[inner] == 1) & (ink[inner + 1] == 1)]
    if len(inner):
        start = np.sort(np.concatenate([start, inner]))
        end = np.sort(np.concatenate([end, inner]))
    return Words(start, end, np.searchsorted(start, bounds))


_TABLE = mix(np.arange(1000, 1256, dtype=U64))
_POWER = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(4095, BASE, U64)]))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(w.start):
        return np.zeros(0, U64)
    size = w.end - w.start
    # Place of each byte within its word; white space between words weighs nothing.
    here = np.arange(w.start[0], w.end[-1])
    which = np.repeat(w.start, np.diff(np.append(w.start, w.end[-1])))
    place = here - which
    long = place >= len(_POWER)
    power = _POWER[np.minimum(place, len(_POWER) - 1)]
    if long.any():
        power[long] = mix(place[long].astype(U64))
    value = _TABLE[data[w.start[0]:w.end[-1]]] * power
    value[_SPACE[data[w.start[0]:w.end[-1]]]] = 0
    return mix(np.add.reduceat(value, w.start - w.start[0]) + size.astype(U64))
