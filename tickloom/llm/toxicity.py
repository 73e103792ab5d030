"""Toxicity: terms of a lexicon, misspelled or not, weighed by their context.

The lexicon is learned from labelled documents: words, and stems of words, that
occur in toxic ones far more often than in others. A document's words are
looked up in it with one edit allowed (see ``lexicon``); a digit between letters
is part of a word, and words that a stem covers stay targets for misspelled ones.
Each hit is judged by its context: between an opening and a closing quotation mark
(double, single or angled, told by what stands on either side of them) it is
quotation, outside abuse, and hits that stand close together weigh more. A logistic regression on
these sums gives the score; it is weighted so that scores are probabilities
under the labels' own share of toxic documents.

Both are fitted on a bounded sample, ``TOXIC`` and ``OTHER`` labelled rows drawn
by a hash of the id, of which copies count once: one part gives the lexicon, the
other the regression. All terms that meet the limits below are in the lexicon: as
many as the sampled texts hold. Labelled texts hardly ever misspell a term, so the
regression also sees toxic texts whose terms were misspelled on purpose. Words
near a term that occur in texts that are not toxic are words of their own.

Results for unusual rows: NULL and empty texts have no hits and get the score
of a document without hits. Rows with NULL doc_id are scored, never learned
from, not held out. Repeated rows are scored each for itself. Labels that
contradict each other, or are NULL, are not learned from. Without labels of both
kinds every score is the share of toxic labels, or 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.anchors import mix
from tickloom.llm.language_id import fold
from tickloom.llm.lexicon import FUZZY_LENGTH, Hit, Lexicon, Term
from tickloom.llm.texts import Piece, Words, flat, in_small_batches, lower, pieces, word_hashes
from tickloom.session import write_and_reread

TOXIC, OTHER = 2000, 4000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: A term occurs in this many toxic texts at least, so many times more often than
#: in others, and the logarithm of these odds is so many standard errors above zero.
MIN_TEXTS, MIN_ODDS, MIN_ERRORS = 5, 5.0, 3.0
STEM_LENGTHS = range(4, 9)
#: Words on either side of a hit.
CONTEXT = 8

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_LETTER[0x80:] = True


_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
#: Kinds of quotation marks: straight and curved double ones, single ones, angled ones.
DOUBLE, SINGLE, ANGLED = 1, 2, 3


def plain(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, which of them belong to words, kinds of quotation marks (0: none)."""
    data = lower(piece.data)
    before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
    # Accented Latin capitals; the multiplication sign among them has no small form.
    capital = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data = np.where(capital, data + 0x20, data).astype(np.uint8)
    letter = _LETTER[data]
    quote = np.zeros(len(data), np.int8)
    quote[data == ord('"')] = DOUBLE
    quote[data == ord("'")] = SINGLE
    general = np.flatnonzero((before == 0xE2) & (data == 0x80))  # dashes, quotation marks
    general = general[general + 1 < len(data)]
    for shift in (-1, 0, 1):
        letter[general + shift] = False
    # A mark stands at its last byte.
    quote[general[np.isin(data[general + 1], [0x9C, 0x9D, 0x9E, 0x9F])] + 1] = DOUBLE
    quote[general[np.isin(data[general + 1], [0x98, 0x99, 0x9A, 0x9B])] + 1] = SINGLE
    latin = np.flatnonzero((before == 0xC2) & (data < 0xC0))     # signs, no letters
    letter[latin] = letter[latin - 1] = False
    quote[latin[np.isin(data[latin], [0xAB, 0xBB])]] = ANGLED
    return data, letter | _inner_digits(data, letter, piece.bounds), quote


def _inner_digits(data: np.ndarray, letter: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Digits with letters of the same text on both sides."""
    digit = _DIGIT[data]
    step = np.diff(np.concatenate([[0], digit.astype(np.int8), [0]]))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inside = np.searchsorted(bounds, start, side="right") == np.searchsorted(bounds, end, side="right")
    first = np.isin(start, bounds)
    near = inside & ~first & (start > 0) & (end < len(data))
    start, end = start[near], end[near]
    near = letter[start - 1] & letter[end]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[near]] += 1
    edge[end[near]] -= 1
    return np.cumsum(edge[:-1]) > 0


def letter_words(piece: Piece, letter: np.ndarray) -> Words:
    """Runs of letters, with digits between them."""
    ink = np.zeros(len(letter) + 2, np.int8)
    ink[1:-1] = letter
    step = np.diff(ink)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = piece.bounds[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(letter))])
    inner = inner[letter[inner] & letter[inner - 1]]
    if len(inner):
        start = np.sort(np.concatenate([start, inner]))
        end = np.sort(np.concatenate([end, inner]))
    return Words(start, end, np.searchsorted(start, piece.bounds))


FEATURES = ["any", "strongest", "abuse", "quotation", "misspelled", "cluster"]


def features(piece: Piece, lexicon: Lexicon) -> np.ndarray:
    """A row of evidence for each text."""
    data, letter, quote = plain(piece)
    found = letter_words(piece, letter)
    out = np.zeros((len(piece.bounds) - 1, len(FEATURES)))
    maybe = np.flatnonzero(lexicon.possible(data, found.start, found.end)) if len(found.start) else []
    if not len(maybe):
        return out
    low = Words(found.start[maybe], found.end[maybe], found.bounds)
    codes = _codes(data, low)
    _, first, back = np.unique(codes, return_index=True, return_inverse=True)
    known: list[Hit | None] = [
        lexicon.look_up(data[low.start[i]:low.end[i]].tobytes()) for i in first]
    hit = np.array([h is not None for h in known])[back]
    at = maybe[hit]
    hits = [known[k] for k in back[hit]]
    text = np.searchsorted(found.bounds, at, side="right") - 1
    for i in np.unique(text):
        mine = np.flatnonzero(text == i) if len(hits) < 2000 else np.arange(
            np.searchsorted(text, i), np.searchsorted(text, i, side="right"))
        a, b = piece.bounds[i], piece.bounds[i + 1]
        quoted = inside_quotation(data[a:b], quote[a:b], found.start[at[mine]] - a)
        out[i] = _evidence(at[mine], [hits[k] for k in mine], found, i, quoted)
    return out


#: White space and punctuation, which stand outside of words.
_GAP = np.zeros(256, bool)
_GAP[[*range(0x21), *map(ord, "()[]{}<>-/.,;:!?\"'")]] = True


def inside_quotation(data: np.ndarray, quote: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each place of a text stands between an opening mark and a closing one of its kind.

    Marks are taken in turn from the start of the text. One with a gap before it only opens,
    with a gap after it only closes, with both it does what is due, and with none, as an
    apostrophe, nothing. A second opening one starts anew; what is never closed is no
    quotation, nor is what single marks hold on several lines.
    """
    marks = np.flatnonzero(quote)
    if not len(marks):
        return np.zeros(len(at), bool)
    width = np.where(data[marks] < 0x80, 1, np.where(quote[marks] == ANGLED, 2, 3))
    left, right = marks - width, marks + 1
    other = np.minimum(right, len(data) - 1)
    before = (left < 0) | _GAP[data[np.maximum(left, 0)]] | (quote[np.maximum(left, 0)] > 0)
    # What follows a mark and begins like another one is a gap where the mark closes.
    after = np.where(data[other] == 0xE2, ~before, _GAP[data[other]]) | (right >= len(data))
    spans, begun, kind = [], -1, 0
    for place, k, b, a in zip(marks.tolist(), quote[marks].tolist(), before.tolist(), after.tolist()):
        if a and begun >= 0 and k == kind:
            spans.append((begun, place))
            begun = -1
        elif b and (begun < 0 or k == kind or kind == SINGLE):
            begun, kind = place, k
    spans = [(a, b) for a, b in spans if quote[a] != SINGLE or not (data[a:b] == 0x0A).any()]
    if not spans:
        return np.zeros(len(at), bool)
    start, end = np.array(spans).T
    last = np.searchsorted(start, at, side="right") - 1
    return (last >= 0) & (at < end[np.maximum(last, 0)])


def _codes(data: np.ndarray, w: Words) -> np.ndarray:
    """Hashes of words that need not follow each other."""
    size = w.end - w.start
    index = np.repeat(w.start - np.cumsum(size) + size, size) + np.arange(size.sum())
    edge = np.cumsum(size)
    return word_hashes(np.where(data[index] == 0x20, 0, data[index]), Words(edge - size, edge, edge))


def _evidence(at: np.ndarray, hits: list[Hit], found: Words, text: int, quoted: np.ndarray) -> list[float]:
    low, high = found.bounds[text], found.bounds[text + 1] - 1
    left, right = np.maximum(at - CONTEXT, low), np.minimum(at + CONTEXT, high)
    weight = np.array([h.weight for h in hits])
    exact = np.array([h.exact for h in hits])
    abuse = weight[exact & ~quoted]
    close = np.searchsorted(at, right, side="right") - np.searchsorted(at, left)
    return [
        float(len(abuse) > 0), float(abuse.max(initial=0)), math.log1p(abuse.sum()),
        math.log1p(weight[exact & quoted].sum()), math.log1p(weight[~exact & ~quoted].sum()),
        math.log(close[~quoted].max(initial=1)),
    ]


# Learning

def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's runs of three words: near copies mostly agree on it."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            data, letter, _ = plain(piece)
            found = letter_words(piece, letter)
            h = own = _codes(data, found) if len(found.start) else np.zeros(0, np.uint64)
            n = np.diff(found.bounds)
            left = np.repeat(found.bounds[1:], n) - np.arange(len(h))
            for k in (1, 2):  # shorter at the end of a text
                h = mix(h + np.where(left > k, mix(np.roll(own, -k)), np.uint64(0)))
            least = np.zeros(len(n), np.uint64)
            if len(h):
                least[n > 0] = np.minimum.reduceat(h, found.bounds[:-1][n > 0])
            rows = batch.slice(piece.begin, len(n))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(least.view(np.int64))], [*rows.schema.names, "sketch"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic, n): texts that have a term, counted within a piece."""
    for batch in batches:
        marks = batch.column("toxic").to_numpy().astype(np.int64)
        for piece in pieces(batch.column("text")):
            data, letter, _ = plain(piece)
            found = letter_words(piece, letter)
            if not len(found.start):
                continue
            _, first, own = np.unique(_codes(data, found), return_index=True, return_inverse=True)
            text = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
            names = [data[found.start[i]:found.end[i]].tobytes().decode("utf-8", "ignore").lower() for i in first]
            pairs = np.unique(np.column_stack([text, own]), axis=0)
            toxic = marks[piece.begin + pairs[:, 0]]
            count: Counter[tuple[str, bool, int]] = Counter()
            for (word, t), n in zip(*_counted(pairs[:, 1], toxic)):
                if len(names[word]) >= 3:
                    count[names[word], False, t] += n
            for k in STEM_LENGTHS:
                ids: dict[str, int] = {}
                stem = np.array([ids.setdefault(w[:k], len(ids)) if k < len(w) else -1 for w in names])
                of = stem[pairs[:, 1]]
                with_stem = np.unique(np.column_stack([pairs[:, 0], of])[of >= 0], axis=0)
                texts = list(ids)
                for (i, t), n in zip(*_counted(with_stem[:, 1], marks[piece.begin + with_stem[:, 0]])):
                    count[texts[i], True, t] += n
            keys = list(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int32()))]
                + [pa.array([count[k] for k in keys], pa.int64())], ["term", "stem", "toxic", "n"])


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Pairs and how often each occurs."""
    if not len(a):
        return [], []
    found, n = np.unique(np.column_stack([a, b]), axis=0, return_counts=True)
    return found.tolist(), n.tolist()


def misspell(text: str, terms: list[Term]) -> str:
    """``text`` with one letter changed, dropped, doubled, swapped or made a digit in each whole term."""
    whole = {t.text for t in terms if not t.stem and len(t.text) >= FUZZY_LENGTH}

    def change(match: re.Match) -> str:
        word = match[0]
        if word.lower() not in whole:
            return word
        code = zlib.crc32(f"{word}{match.start()}".encode())
        at = 1 + code % (len(word) - 1)
        kind = code // 97 % 5
        if kind == 4 and at + 1 < len(word):
            return word[:at] + word[at + 1] + word[at] + word[at + 2:]
        inner = at + 1 < len(word)
        middle = ("", 2 * word[at], "q" if word[at] == "x" else "x", "0" if inner else "z", "z")[kind]
        return word[:at] + middle + word[at + 1:]

    return re.sub(r"[^\W\d_]+(?:\d+[^\W\d_]+)*", change, text)


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    ordinary: frozenset[str]
    weights: np.ndarray
    bias: float

    def scores(self, piece: Piece, lexicon: Lexicon) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(piece, lexicon) @ self.weights + self.bias, -30, 30)))


def _choose(rows: list, toxic: int, other: int) -> list[Term]:
    """Stems first, the shorter the better, where no shorter one covers them; then all words:
    those that a stem covers are still what a misspelled one can be near to."""
    scored = []
    for r in rows:
        odds = ((r["pos"] + 0.5) / (toxic + 1)) / ((r["neg"] + 0.5) / (other + 1))
        error = math.sqrt(1 / (r["pos"] + 0.5) + 1 / (r["neg"] + 0.5))
        if odds >= MIN_ODDS and math.log(odds) >= MIN_ERRORS * error:
            scored.append((r["term"], r["stem"], odds, r["pos"]))
    # A stem has to bring together more than its commonest word says alone.
    words_of = Counter()
    for term, stem, _, pos in scored:
        if not stem:
            for k in STEM_LENGTHS:
                words_of[term[:k]] = max(words_of[term[:k]], pos)
    stems: dict[str, Term] = {}
    chosen: list[Term] = []

    def covered(text: str, weight: float) -> bool:
        return any(text[:k] in stems and stems[text[:k]].weight >= weight
                   for k in STEM_LENGTHS if k <= len(text))

    scored.sort(key=lambda s: (not s[1], len(s[0]), -s[3], s[0]))
    for term, stem, odds, pos in scored:
        weight = math.log(odds)
        if stem and (covered(term, weight) or pos <= words_of[term]):
            continue
        chosen.append(Term(term, stem, weight, weight / 2))
        if stem:
            stems[term] = chosen[-1]
    return sorted(chosen, key=lambda t: (-t.weight, t.text))


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps, slightly drawn to zero."""
    z = np.column_stack([x, np.ones(len(x))])
    pull = np.full(z.shape[1], 1e-3 * max(w.sum(), 1))
    pull[-1] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + pull * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """The lexicon and the regression, from labelled rows outside the held-out fold."""
    marked = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("high"))
        .where("toxic = high").drop("high").where(fold(folds) != held_out))
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(sum(total.values()), 1)
    certain = Model([], frozenset(), np.zeros(len(FEATURES)), math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not (total.get(0) and total.get(1)):
        return certain
    luck = F.xxhash64("doc_id", F.lit("toxicity"))
    drawn = [marked.where(F.col("toxic") == k).orderBy(luck, "doc_id").limit(n)
             for k, n in ((1, TOXIC), (0, OTHER))]
    # At most TOXIC + OTHER ids: small enough to be sent to every scan.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = (
        docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id")
        .mapInArrow(_sketch, "doc_id long, text string, toxic int, sketch long")
        .dropDuplicates(["sketch", "toxic"]))
    part = F.pmod(F.xxhash64("sketch", F.lit("part")), F.lit(3))
    sample = write_and_reread(rows.withColumn("part", part).select("text", "toxic", "part"))
    size = {(r["toxic"], r["one"]): r["n"] for r in sample.groupBy(
        "toxic", (F.col("part") < 2).alias("one")).agg(F.count("*").alias("n")).collect()}
    counted = sample.where("part < 2").mapInArrow(
        _terms, "term string, stem boolean, toxic int, n long").groupBy("term", "stem").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    toxic, other = size.get((1, True), 0), size.get((0, True), 0)
    rare = (F.col("pos") + 0.5) * (other + 1) >= F.lit(MIN_ODDS * (toxic + 1)) * (F.col("neg") + 0.5)
    # Terms in MIN_TEXTS of at most TOXIC texts.
    best = counted.where((F.col("pos") >= MIN_TEXTS) & rare).orderBy(F.desc("pos"), "term", "stem").collect()
    terms = _choose(best, toxic, other)

    near = Lexicon(terms)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column("term"))
            maybe = near.possible(data, bounds[:-1], bounds[1:]) if len(data) else np.zeros(len(batch), bool)
            found = [bool(m) and (h := near.find(w)) is not None and not h.exact
                     for m, w in zip(maybe, batch.column("term").to_pylist())]
            yield batch.filter(pa.array(found, pa.bool_()))

    ordinary = frozenset(r["term"] for r in counted.where("NOT stem AND neg > 0").select(
        "term").mapInArrow(neighbours, "term string").collect())

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, ordinary)
        for batch in batches:
            bad = batch.filter(pa.array(batch.column("toxic").to_numpy() == 1))
            spoiled = pa.array([misspell(t, terms) for t in bad.column("text").to_pylist()], pa.string())
            for texts, toxic in ((batch.column("text"), batch.column("toxic")),
                                 (spoiled, bad.column("toxic"))):
                for piece in pieces(texts):
                    x = features(piece, lexicon)
                    yield pa.RecordBatch.from_arrays([
                        toxic.slice(piece.begin, len(x)),
                        pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    fit = sample.where("part = 2").mapInArrow(evidence, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in fit], float)
    if not terms or y.min(initial=1) == y.max(initial=0):
        return certain
    x = np.array([r["x"] for r in fit])
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    return Model(terms, ordinary, *_fit(x, y, weight))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = learn(docs, labels, folds, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms, model.ordinary)
        for batch in batches:
            for piece in pieces(batch.column("text")):
                rows = batch.slice(piece.begin, piece.end - piece.begin)
                score = model.scores(piece, lexicon)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), rows.column("held_out"), pa.array(score),
                    pa.array((score >= THRESHOLD).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    return docs.select(
        "doc_id", F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out"), "text",
    ).mapInArrow(run, SCORED)
