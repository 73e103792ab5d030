"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE piece model (its file is a parameter) is applied as its library does:
spaces become a mark, one is put before the text, and of all neighbours that
join to a piece the best ranked are merged, again and again. With dropout, a
candidate merge is skipped where a keyed hash of (seed, document, place in it,
position, piece) falls under the rate, so every occurrence of a word has draws of
its own. A rerun gives the same pieces, and every segmentation decodes to the text.

Pieces never hold the mark behind other characters, so texts fall into chunks
(a run of marks and what follows it) that are encoded apart, all of one length
together, a merge each per step; a few long ones use an agenda of their own. Each
distinct chunk is merged without dropout once for a stretch of text. Where an
occurrence's draws skip none of these merges, its pieces are the same; all other
occurrences are merged for themselves.

Characters without a piece, the mark itself among them, become byte pieces.
Results for unusual rows: NULL texts have NULL ids; empty ones none. Rows with
NULL doc_id are encoded like others. Repeated rows get equal pieces. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.anchors import BASE, U64, Rolling, mix
from tickloom.llm.repeats import _ranges
from tickloom.llm.texts import Piece, in_small_batches, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
STRETCH = 1 << 21
#: Symbols of a chunk up to which chunks are merged together, and up to which if they are several.
TOGETHER, SEVERAL_TOGETHER = 48, 400
_MARK = "▁"
_NONE = np.int64(1 << 40)


class Model:
    """Pieces, ranks and merges of a piece model."""

    def __init__(self, proto: bytes):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        byte = [sp.is_byte(i) for i in range(size)]
        normal = {t: i for i, t in enumerate(text) if not special[i] and not byte[i]}
        if any(_MARK in t.lstrip(_MARK) for t in normal):
            raise ValueError("a piece holds the mark behind other characters")
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(byte):
            self.byte_ids[int(text[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.is_byte = np.array(byte)
        # Rank: the better the score the lower; equal scores by id.
        score = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.empty(size, np.int64)
        self.rank[np.lexsort((np.arange(size), -score))] = np.arange(size)
        self.by_rank = np.argsort(self.rank)
        self.char = np.full(0x110000, -1, np.int64)
        for t, i in normal.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        self.mark = normal[_MARK]
        self.char[0x20], self.char[ord(_MARK)] = self.mark, -1
        raw = [b"" if s else bytes([int(t[3:5], 16)]) if b else t.replace(_MARK, " ").encode()
               for t, s, b in zip(text, special, byte)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        pairs = {(normal[t[:k]], normal[t[k:]]): i for t, i in normal.items()
                 for k in range(1, len(t)) if t[:k] in normal and t[k:] in normal}
        self._fill(np.array([a * size + b for a, b in pairs]), self.rank[list(pairs.values())])
        self.size = size

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open table of pairs, looked up by whole arrays."""
        bits = max(12, int(len(keys)).bit_length() + 3)
        self._shift = U64(64 - bits)
        self._keys = np.full((1 << bits) + 64, -1, np.int64)
        self._values = np.full((1 << bits) + 64, _NONE, np.int64)
        todo, self._probes = np.arange(len(keys)), 0
        home = self._home(keys)
        while len(todo):
            slot = home[todo] + self._probes
            free = np.flatnonzero(self._keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self._keys[slot[take]] = keys[todo[take]]
            self._values[slot[take]] = values[todo[take]]
            todo = np.delete(todo, take)
            self._probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(BASE)) >> self._shift).astype(np.int64)

    def merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two pieces make, or _NONE."""
        keys = left * self.size + right
        slot = self._home(keys)
        out = np.where(self._keys[slot] == keys, self._values[slot], _NONE)
        for k in range(1, self._probes):
            out = np.where(self._keys[slot + k] == keys, self._values[slot + k], out)
        return out


def _skipped(key, position, rank, rate: float):
    """Whether dropout skips a candidate; ``key`` stands for seed, document, place and chunk."""
    return mix(mix(key + position.astype(U64) * U64(BASE)) + rank.astype(U64)) < U64(
        min(int(rate * (1 << 64)), (1 << 64) - 1))


def merge_together(
    model: Model, symbols: np.ndarray, keys: np.ndarray, rate: float, merges: list | None = None,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pieces of chunks of one length, rows of ``symbols``; each step merges once in each.

    Returns (rows, a row of pieces for each), by number of pieces; ``merges`` takes (rows,
    positions, ranks) of each step.
    """
    n, out = len(symbols), []
    rows, place = np.arange(n), np.broadcast_to(np.arange(symbols.shape[1]), symbols.shape)

    def ranks(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the merges at some places, without those that dropout skips."""
        found = model.merge_rank(symbols[of, at], symbols[of, at + 1])
        if rate:
            some = np.flatnonzero(found < _NONE)
            skip = _skipped(keys[of[some]], place[of[some], at[some]], found[some], rate)
            found[some[skip]] = _NONE
        return found

    if symbols.shape[1] > 1:
        every = np.indices((n, symbols.shape[1] - 1)).reshape(2, -1)
        rank = ranks(*every).reshape(n, -1)
    while len(rows) and symbols.shape[1] > 1:
        best = rank.argmin(axis=1)
        value = rank[np.arange(len(rows)), best]
        live = value < _NONE
        if not live.all():
            out.append((rows[~live], symbols[~live]))
        rows, keys, best, value = rows[live], keys[live], best[live], value[live]
        if merges is not None:
            merges.append((rows, place[live, best], value))
        column = np.arange(symbols.shape[1] - 1)
        after = column[None, :] + (column[None, :] > best[:, None])
        symbols, place = (np.take_along_axis(x[live], after, axis=1) for x in (symbols, place))
        each = np.arange(len(rows))
        symbols[each, best] = model.by_rank[value]
        # Only the pairs of the new piece change.
        rank = np.take_along_axis(rank[live], column[None, :-1] + (column[None, :-1] >= best[:, None]), axis=1)
        for at, some in ((best - 1, best > 0), (best, best < symbols.shape[1] - 1)):
            some = np.flatnonzero(some)
            rank[some, at[some]] = ranks(some, at[some])
    return [*out, (rows, symbols)] if len(rows) else out


def merge_agenda(model: Model, symbols: np.ndarray, key: np.uint64, rate: float) -> np.ndarray:
    """Pieces of one chunk: the same merges, from an agenda of candidates."""
    n = len(symbols)
    sym, prev, following = symbols.copy(), np.arange(n) - 1, np.arange(1, n + 1)
    rank = model.merge_rank(sym[:-1], sym[1:])
    key = np.full(1, key, U64)

    def dropped(at: int, r: int) -> bool:
        return rate > 0 and bool(_skipped(key, np.array([at]), np.array([r]), rate)[0])

    agenda = [(int(r), i, int(sym[i]), int(sym[i + 1])) for i, r in enumerate(rank) if r < _NONE]
    heapq.heapify(agenda)
    gone = np.zeros(n, bool)
    while agenda:
        r, at, left, right = heapq.heappop(agenda)
        after = following[at]
        if gone[at] or after >= n or sym[at] != left or sym[after] != right or dropped(at, r):
            continue
        sym[at], gone[after] = model.by_rank[r], True
        following[at] = following[after]
        if following[at] < n:
            prev[following[at]] = at
        for a, b in ((prev[at], at), (at, following[at])):
            if a >= 0 and b < n:
                new = int(model.merge_rank(sym[a:a + 1], sym[b:b + 1])[0])
                if new < _NONE:
                    heapq.heappush(agenda, (new, int(a), int(sym[a]), int(sym[b])))
    return sym[~gone]


def _alone(length: np.ndarray) -> np.ndarray:
    """Chunks that are merged by an agenda of their own: long ones, of a length that few have."""
    _, back, n = np.unique(length, return_inverse=True, return_counts=True)
    return length > np.where(n[back] > 3, SEVERAL_TOGETHER, TOGETHER)


def _merge_all(
    model: Model, flat: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray, rate: float,
    merges: list | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all chunks, end to end, and how many each has; ``merges`` takes (chunks,
    positions, ranks) of those merged together."""
    blocks, alone = [], _alone(length)
    for i in np.flatnonzero(alone):
        row = flat[start[i]:start[i] + length[i]]
        blocks.append((np.array([i]), merge_agenda(model, row, keys[i], rate)[None, :]))
    order = np.argsort(np.where(alone, -1, length), kind="stable")[np.count_nonzero(alone):]
    sizes, at = np.unique(length[order], return_index=True)
    for n, a, b in zip(sizes.tolist(), at, np.append(at[1:], len(order))):
        own = order[a:b]
        steps: list | None = None if merges is None else []
        found = merge_together(model, flat[start[own][:, None] + np.arange(n)], keys[own], rate, steps)
        blocks += [(own[rows], table) for rows, table in found]
        for rows, position, rank in steps or ():
            merges.append((own[rows], position, rank))
    count = np.zeros(len(start), np.int64)
    for own, table in blocks:
        count[own] = table.shape[1]
    begin = np.cumsum(count) - count
    ids = np.zeros(count.sum(), np.int64)
    for own, table in blocks:
        ids[begin[own][:, None] + np.arange(table.shape[1])] = table
    return ids, count


def _touched(key: np.ndarray, chunk: np.ndarray, merges: list, rate: float) -> np.ndarray:
    """Occurrences with a draw that skips one of their chunk's merges."""
    if not merges:
        return np.zeros(0, np.int64)
    own, position, rank = (np.concatenate(x) for x in zip(*merges))
    order = np.argsort(own, kind="stable")
    own, position, rank = own[order], position[order], rank[order]
    count = np.bincount(own, minlength=int(chunk.max()) + 1)[chunk]
    begin = np.searchsorted(own, chunk)
    at, which = _ranges(begin, count), np.repeat(np.arange(len(chunk)), count)
    return np.unique(which[_skipped(key[which], position[at], rank[at], rate)])


def encode(
    model: Model, piece: Piece, documents: np.ndarray, rate: float = DROPOUT, seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and their bounds; ``documents`` are 64-bit keys."""
    points = np.frombuffer(piece.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = (piece.data & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lead)])[piece.bounds]
    symbol = model.char[points]
    # Characters without a piece: their bytes.
    size = np.ones(len(points), np.int64)
    missing = np.flatnonzero(symbol < 0)
    at_byte = np.flatnonzero(lead)
    width = np.diff(np.append(at_byte, len(piece.data)))
    size[missing] = width[missing]
    flat = np.repeat(symbol, size)
    flat[flat < 0] = model.byte_ids[piece.data[_ranges(at_byte[missing], width[missing])]]
    bounds = np.concatenate([[0], np.cumsum(size)])[bounds]
    # The mark before each text.
    filled = np.flatnonzero(np.diff(bounds) > 0)
    flat = np.insert(flat, bounds[filled], model.mark)
    bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
    if not len(flat):
        return flat, bounds
    # Chunks.
    byte, mark = model.is_byte[flat], flat == model.mark
    cut = np.ones(len(flat), bool)
    cut[1:] = byte[1:] | byte[:-1] | (mark[1:] & ~mark[:-1])
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(flat))
    text = np.searchsorted(bounds, start, side="right") - 1
    chunk = mix(Rolling(mix(flat.astype(U64))).of(start, end) + (end - start).astype(U64))
    length = end - start
    _, first, back = np.unique(chunk, return_index=True, return_inverse=True)
    merges: list = []
    parts, count = _merge_all(model, flat, start[first], length[first], chunk[first], 0.0, merges if rate else None)
    if rate:
        key = mix(chunk + mix(documents[text] + mix((start - bounds[text]).astype(U64) + U64(seed))))
        # What an agenda has merged is not on record.
        again = np.union1d(_touched(key, back, merges, rate), np.flatnonzero(_alone(length[first])[back]))
        own, size = _merge_all(model, flat, start[again], length[again], key[again], rate)
        back[again] = len(count) + np.arange(len(again))
        parts, count = np.concatenate([parts, own]), np.concatenate([count, size])
    ids = parts[_ranges((np.cumsum(count) - count)[back], count[back])]
    ends = np.concatenate([[0], np.cumsum(count[back])])
    return ids, ends[np.searchsorted(start, bounds)]


def decode(model: Model, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and their bounds."""
    data = model.raw[_ranges(model.raw_start[ids], model.raw_size[ids])] if len(ids) else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(model.raw_size[ids])])[bounds]
    # The mark before each text is no part of it.
    some = np.diff(ends) > 0
    marks = ends[:-1][some]
    marks = marks[data[marks] == 0x20]
    keep = np.ones(len(data), bool)
    keep[marks] = False
    return data[keep], ends - np.searchsorted(marks, ends)


def _keyed(docs: DataFrame) -> DataFrame:
    return in_small_batches(docs).select("doc_id", F.xxhash64("doc_id").alias("key"), "text")


def _runner(spark, path: str, make):
    """Runs ``make(model, batch, piece, ids, bounds)`` on encoded stretches of text."""
    with open(path, "rb") as file:
        proto = spark.sparkContext.broadcast(file.read())  # a model file: less than 1 MB

    def run_with(rate: float, seed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(proto.value)
            for batch in batches:
                key = batch.column("key").to_numpy(zero_copy_only=False).view(U64)
                for piece in pieces(batch.column("text"), STRETCH):
                    ids, bounds = encode(model, piece, key[piece.begin:piece.end], rate, seed)
                    yield make(model, batch.slice(piece.begin, piece.end - piece.begin), piece, ids, bounds)

        return run

    return run_with


def _lists(rows: pa.RecordBatch, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
    null = rows.column("text").is_null()
    return pa.array([None if x else v for x, v in zip(null.to_pylist(), lists.to_pylist())],
                    pa.list_(pa.int32())) if rows.column("text").null_count else lists


def encoded(
    docs: DataFrame, rate: float = DROPOUT, seed: int = SEED, path: str = MODEL,
) -> DataFrame:
    """(doc_id, n_pieces, ids): the pieces of each text."""

    def make(model, rows, piece, ids, bounds):
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(bounds)), _lists(rows, ids, bounds)],
            ["doc_id", "n_pieces", "ids"])

    return _keyed(docs).mapInArrow(
        _runner(docs.sparkSession, path, make)(rate, seed), "doc_id long, n_pieces long, ids array<int>")


def decoded(pieces_: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    with open(path, "rb") as file:
        proto = pieces_.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(proto.value)
        for batch in batches:
            lists = batch.column("ids")
            size = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
            data, bounds = decode(model, lists.flatten().to_numpy().astype(np.int64),
                                  np.concatenate([[0], np.cumsum(size)]))
            text = [None if null else data[a:b].tobytes().decode() for a, b, null in zip(
                bounds[:-1], bounds[1:], lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return pieces_.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


CHECKED = ("doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids_sha256 string, "
           "lossless boolean")


def checked(
    docs: DataFrame, rate: float = DROPOUT, seed: int = SEED, path: str = MODEL,
) -> DataFrame:
    """Each text encoded and decoded again: columns as in ``CHECKED``.

    ``ids_sha256`` is over the ids as little-endian 32-bit numbers.
    """

    def make(model, rows, piece, ids, bounds):
        data, at = decode(model, ids, bounds)
        same = [bool(np.array_equal(data[a:b], piece.data[c:d])) for a, b, c, d in zip(
            at[:-1], at[1:], piece.bounds[:-1], piece.bounds[1:])]
        byte = np.concatenate([[0], np.cumsum(model.is_byte[ids])])[bounds]
        small = ids.astype("<i4")
        return pa.RecordBatch.from_arrays([
            rows.column("doc_id"), pa.array(np.diff(piece.bounds)), pa.array(np.diff(bounds)),
            pa.array(np.diff(byte)),
            pa.array([hashlib.sha256(small[a:b].tobytes()).hexdigest()
                      for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
            pa.array(same, pa.bool_())],
            ["doc_id", "n_bytes", "n_pieces", "n_byte_pieces", "ids_sha256", "lossless"])

    return _keyed(docs).mapInArrow(_runner(docs.sparkSession, path, make)(rate, seed), CHECKED)
