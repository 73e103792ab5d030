"""Quality rules: base counts, and divergence from the languages' histograms.

For each language with ``REFERENCE_WORDS`` words two reference histograms are
counted over all its documents that pass the base rules: classes of characters,
and the most common words. A document is compared with every reference by
Jensen-Shannon distance (0 to 1) and rejected if even the nearest language is too
far, by characters or by words. Guards: a histogram is only judged where the
document has enough characters or words for it to mean something, and documents
of a language without a reference are not judged by those of others.

Three passes over the texts, none shuffles them: counts of words, of which each
language's most common ones are taken; the references; the verdicts. The first
two sum by (lang, word or class) in Spark.

Results for unusual rows: NULL and empty texts have no words and fail the base
rules. Repeated rows are judged each for itself. Rows with NULL lang are judged
by all references but add to none; without any reference only the base rules count. Other
columns are ignored by ``judged`` and carried by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.anchors import BASE, U64, Rolling, byte_codes, mix
from tickloom.llm.texts import Piece, Words, in_small_batches, lower, pieces, word_hashes, words
from tickloom.session import write_and_reread

MIN_WORDS = 50
REPEAT_PERCENT = 50
COMMON = 64
#: Languages with fewer words in passing documents have no reference.
REFERENCE_WORDS = 2000
MAX_CHARS, MAX_WORDS = 0.30, 0.48
GUARD_CHARS, GUARD_WORDS = 200, 100

# Classes of bytes.
_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "symbol", "mark", "wide"]
_CLASS = np.full(256, _CLASSES.index("mark"), np.uint8)
_CLASS[ord("a"):ord("z") + 1] = _CLASSES.index("lower")
_CLASS[ord("A"):ord("Z") + 1] = _CLASSES.index("upper")
_CLASS[ord("0"):ord("9") + 1] = _CLASSES.index("digit")
_CLASS[[0x20, 0x09]] = _CLASSES.index("space")
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = _CLASSES.index("newline")
_CLASS[list(b".,;:?'\"-()")] = _CLASSES.index("stop")
_CLASS[list(b"#*$%&|<>")] = _CLASSES.index("symbol")
_CLASS[0xC0:] = _CLASSES.index("wide")
_IGNORED = len(_CLASSES)
_CLASS[0x80:0xC0] = _IGNORED  # the rest of a character
_SYMBOL = _CLASS == _CLASSES.index("symbol")


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeat_words(found: Words, codes: np.ndarray) -> np.ndarray:
    """Words of each text in runs of three that occur in it again."""
    n_words = np.diff(found.bounds)
    text = np.repeat(np.arange(len(n_words)), n_words)
    triple = np.zeros(len(codes), U64)
    for k in range(3):
        triple = mix(triple + np.roll(codes, -k))
    whole = np.flatnonzero(np.repeat(found.bounds[1:], n_words) - np.arange(len(codes)) >= 3)
    key = mix(triple[whole] + text[whole].astype(U64) * U64(BASE))
    _, back, copies = np.unique(key, return_inverse=True, return_counts=True)
    again = whole[copies[back] > 1]
    repeated = np.zeros(len(codes), bool)
    for k in range(3):
        repeated[again + k] = True
    return _per_text(repeated, found.bounds)


def base_counts(piece: Piece, found: Words, codes: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of each text."""
    data, bounds = piece.data, piece.bounds
    n_words = np.diff(found.bounds)

    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    word_chars = _per_text(chars[found.end] - chars[found.start], found.bounds)

    # Lines: cut at newlines and where texts end.
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(data == 0x0A) + 1]))
    start, end = cuts[:-1], cuts[1:].copy()
    if len(start):
        end -= data[end - 1] == 0x0A
    wordy = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end = start[wordy], end[wordy]
    line_text = np.searchsorted(bounds, start, side="right") - 1
    rolling = Rolling(byte_codes()[data])
    line = mix(rolling.of(start, end) + (end - start).astype(U64))
    key = mix(line + line_text.astype(U64) * U64(BASE))
    _, first = np.unique(key, return_index=True)
    distinct = np.bincount(line_text[first], minlength=len(n_words))
    n_lines = np.bincount(line_text, minlength=len(n_words))

    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _per_text(_SYMBOL[data], bounds),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeat_words(found, codes),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * n)


def char_histograms(piece: Piece) -> np.ndarray:
    n, width = len(piece.bounds) - 1, _IGNORED + 1
    text = np.repeat(np.arange(n), np.diff(piece.bounds))
    return np.bincount(text * width + _CLASS[piece.data], minlength=n * width).reshape(
        n, width)[:, :_IGNORED]


def word_counts(codes: np.ndarray, bounds: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, column, n): counts of the common words (sorted hashes); all others are the last column."""
    width = len(common) + 1
    at = np.searchsorted(common, codes)
    hit = (common[np.minimum(at, len(common) - 1)] == codes) if len(common) else at < 0
    at = np.where(hit, at, len(common))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key, n = np.unique(text * width + at, return_counts=True)
    return key // width, key % width, n


def distance(text: np.ndarray, column: np.ndarray, n: np.ndarray, texts: int, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, in base 2, of each text's counts to a reference histogram."""
    total = np.bincount(text, weights=n, minlength=texts)
    p = n / total[text]
    q = (reference / max(reference.sum(), 1))[column]
    m = (p + q) / 2
    both = p * np.log2(p / m) + np.where(q > 0, q * np.log2(np.where(q > 0, q, 1) / m), 0)
    # What a text lacks counts with the reference's whole share.
    lacks = (reference.sum() > 0) - np.bincount(text, weights=q, minlength=texts)
    return np.sqrt(np.clip((np.bincount(text, weights=both, minlength=texts) + lacks) / 2, 0, 1))


def _plain(piece: Piece) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their hashes, and the hashes of the words in lower case."""
    found = words(piece)
    return found, word_hashes(piece.data, found), word_hashes(lower(piece.data), found)


def _langs(batch: pa.RecordBatch, piece: Piece) -> np.ndarray:
    return np.array(batch.column("lang").slice(piece.begin, piece.end - piece.begin).to_pylist(), object)


def _passing(found: Words, codes: np.ndarray) -> np.ndarray:
    return ~base_failed({"n_words": np.diff(found.bounds), "n_repeat_words": repeat_words(found, codes)})


def _summed(parts: list[tuple[str, np.ndarray, np.ndarray]], key: str) -> pa.RecordBatch:
    """Rows (lang, key, n) of a batch, each key of a language once."""
    schema = pa.schema([("lang", pa.string()), (key, pa.int64()), ("n", pa.int64())])
    table = pa.Table.from_arrays([
        pa.concat_arrays([pa.nulls(0, pa.string()), *(pa.repeat(pa.scalar(x, pa.string()), len(k)) for x, k, _ in parts)]),
        *(pa.array(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in parts)]), pa.int64()) for i in (1, 2)),
    ], schema=schema).group_by(["lang", key]).aggregate([("n", "sum")])
    return pa.RecordBatch.from_arrays(
        [table.column(x).combine_chunks() for x in ("lang", key, "n_sum")], schema=schema)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): words of the passing documents of a batch."""
    for batch in batches:
        parts = []
        for piece in pieces(batch.column("text")):
            found, codes, low = _plain(piece)
            lang = np.where(_passing(found, codes), _langs(batch, piece), None)
            of_word = np.repeat(lang, np.diff(found.bounds))
            for name in {x for x in lang.tolist() if x is not None}:
                word, n = np.unique(low[of_word == name], return_counts=True)
                parts.append((name, word.view(np.int64), n))
        yield _summed(parts, "word")


@dataclass(frozen=True)
class References:
    common: np.ndarray                            # sorted hashes of words
    by_lang: dict[str, tuple[np.ndarray, np.ndarray]]  # histograms of characters and of words


def _counted(common: np.ndarray, langs: frozenset[str]):
    """(lang, pos, n): classes of characters, then common words and all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in pieces(batch.column("text")):
                found, codes, low = _plain(piece)
                good = _passing(found, codes)
                chars = char_histograms(piece)
                text, column, n = word_counts(low, found.bounds, common)
                lang = _langs(batch, piece)
                for name in langs.intersection(lang.tolist()):
                    own = good & (lang == name)
                    mine = own[text]
                    parts.append((name, np.arange(len(_CLASSES)), chars[own].sum(axis=0)))
                    parts.append((name, len(_CLASSES) + column[mine], n[mine]))
            yield _summed(parts, "pos")

    return run


def references(docs: DataFrame) -> References:
    """Histograms of each language, over all documents that pass the base rules."""
    in_small_batches(docs)
    docs = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    seen = docs.mapInArrow(_common, "lang string, word long, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    seen = write_and_reread(seen)
    langs = sorted(r["lang"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).where(
        F.col("n") >= REFERENCE_WORDS).select("lang").collect())
    if not langs:
        return References(np.zeros(0, U64), {})
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = seen.where(F.col("lang").isin(langs)).withColumn(
        "rank", F.row_number().over(by_rank)).where(F.col("rank") <= COMMON).collect()
    common = np.unique(np.array([r["word"] for r in top], np.int64).view(U64))
    summed = docs.where(F.col("lang").isin(langs)).mapInArrow(
        _counted(common, frozenset(langs)), "lang string, pos long, n long").groupBy("lang", "pos").agg(
        F.sum("n").alias("n")).collect()
    width = len(_CLASSES)
    table = {x: np.zeros(width + len(common) + 1) for x in langs}
    for r in summed:
        table[r["lang"]][r["pos"]] = r["n"]
    return References(common, {x: (t[:width], t[width:]) for x, t in table.items()})


def verdicts(piece: Piece, lang: np.ndarray, refs: References) -> dict[str, np.ndarray]:
    """Base columns, the distances to the nearest language, and what is kept."""
    found, codes, low = _plain(piece)
    out = base_counts(piece, found, codes)
    n = len(piece.bounds) - 1
    chars = char_histograms(piece)
    of_chars = (*(at := np.nonzero(chars)), chars[at])
    of_words = word_counts(low, found.bounds, refs.common)
    by_chars = np.full((n, len(refs.by_lang) + 1), np.inf)
    by_words = by_chars.copy()
    for k, (c, w) in enumerate(refs.by_lang.values()):
        by_chars[:, k], by_words[:, k] = distance(*of_chars, n, c), distance(*of_words, n, w)
    js_chars, js_words = by_chars.min(axis=1), by_words.min(axis=1)
    known = np.array([bool(refs.by_lang) and (x is None or x in refs.by_lang) for x in lang], bool)
    far = (((chars.sum(axis=1) >= GUARD_CHARS) & (js_chars > MAX_CHARS))
           | ((out["n_words"] >= GUARD_WORDS) & (js_words > MAX_WORDS))) & known
    failed = base_failed(out)
    return out | {
        "base_failed": failed, "kept": ~failed & ~far,
        "js_chars": np.where(np.isfinite(js_chars), js_chars, np.nan),
        "js_words": np.where(np.isfinite(js_words), js_words, np.nan),
    }


JUDGED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double")


def judged(docs: DataFrame) -> DataFrame:
    """Columns as in ``JUDGED``, a row for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                out = verdicts(piece, _langs(batch, piece), refs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(piece.begin, piece.end - piece.begin),
                     *(pa.array(v) for v in out.values())], ["doc_id", *out])

    names = [x.split()[0] for x in JUDGED.split(", ")]
    return docs.mapInArrow(run, JUDGED).select(*names)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                rows = batch.slice(piece.begin, piece.end - piece.begin)
                yield rows.filter(pa.array(verdicts(piece, _langs(batch, piece), refs)["kept"]))

    return docs.mapInArrow(run, docs.schema)
