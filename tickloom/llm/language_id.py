"""Language identification: averaged hashed subword embeddings, linear softmax.

Byte n-grams of the lower-cased text are hashed into buckets. A text is the
average of its buckets' embeddings; a linear softmax on it is trained together
with the embeddings by stochastic gradient descent in numpy. The sample it is
fitted on is bounded: ``SAMPLE`` rows, or ``PER_LANG`` for each language if that is
more; as many of each language, or all of one that has fewer, drawn by a hash of the
id. Every language of the training folds is learned. A part of the sample is kept back
to set the softmax's temperature and the score under which a prediction is rejected.

Fitted, an n-gram's effect on the logits is a row of one table of fixed size,
so that texts are read once, whole, and never shuffled.

Results for unusual rows: NULL texts and texts without a letter are ``und``
with score 0, not accepted; so is everything if no row can be learned from.
Rows with NULL doc_id are never learned from and not held out. Repeated rows
are judged each for itself; texts of any length are read whole, each in one task;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.texts import Piece, in_small_batches, lower, pieces

BUCKETS = 1 << 14
GRAMS = (2, 3, 4)
DIM = 16
SAMPLE, PER_LANG = 2400, 40
EPOCHS, BATCH, RATE = 20, 32, 0.5
#: Least accuracy of accepted predictions on the part kept back.
ACCEPTED_ACCURACY = 0.99
FOLDS, HELD_OUT = 5, 0

_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


def fold(folds: int) -> Column:
    """The fold of a document; NULL without an id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def grams(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: buckets, and the text each belongs to."""
    data = lower(piece.data)
    data = np.where((data >= 9) & (data <= 13), 32, data).astype(np.uint32)
    text = np.repeat(np.arange(len(piece.bounds) - 1), np.diff(piece.bounds))
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint32) + np.uint32(n)
        for k in range(n):
            h = (h ^ data[k:len(data) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(np.log2(BUCKETS)))
        inside = text[: len(h)] == text[n - 1:]
        yield h[inside], text[: len(h)][inside]


def has_letter(piece: Piece) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[piece.data])])
    out = sums[piece.bounds[1:]] > sums[piece.bounds[:-1]]
    for i in np.flatnonzero(~out):
        raw = piece.data[piece.bounds[i]:piece.bounds[i + 1]].tobytes()
        out[i] = bool(raw) and _LETTER.search(raw.decode("utf-8", "ignore")) is not None
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each text and how often they occur: at most BUCKETS of each."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            n = len(piece.bounds) - 1
            key = [t * BUCKETS + h for h, t in grams(piece)]
            key, times = np.unique(np.concatenate(key) if key else np.zeros(0, np.int64),
                                   return_counts=True)
            cuts = np.searchsorted(key, np.arange(n + 1) * BUCKETS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("lang").slice(piece.begin, n),
                pa.ListArray.from_arrays(cuts, pa.array((key % BUCKETS).astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
            ], ["lang", "bucket", "times"])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # effect of each bucket on the logits
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, piece: Piece) -> np.ndarray:
        """Calibrated probabilities, a row for each text."""
        n = len(piece.bounds) - 1
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for h, t in grams(piece):
            count += np.bincount(t, minlength=n)
            for c in range(len(self.langs)):
                total[:, c] += np.bincount(t, weights=self.table[h, c], minlength=n)
        return _softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model | None:
    """Fit on (lang, buckets, times); every fifth row is kept back for calibration."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None

    def averages(part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(part), BUCKETS), np.float32)
        for k, i in enumerate(part):
            x[k, rows[i][1]] = rows[i][2] / rows[i][2].sum()
        return x

    y = np.array([langs.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)
    kept_back = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    fit = np.flatnonzero(~kept_back)
    embed = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    weight = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            part = order[a:a + BATCH]
            x = averages(part)
            hidden = x @ embed
            error = _softmax(hidden @ weight + bias)
            error[np.arange(len(part)), y[part]] -= 1
            error = (error / len(part)).astype(np.float32)
            back = error @ weight.T
            weight -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            # Averages are small, so embeddings need larger steps.
            embed -= rate * 100 * (x.T @ back)
    check = np.flatnonzero(kept_back) if kept_back.any() else fit
    logits = np.concatenate([averages(check[a:a + 256]) @ embed @ weight + bias
                             for a in range(0, len(check), 256)])
    grid = np.geomspace(0.5, 10, 60)
    right = y[check]
    loss = [-np.log(_softmax(logits / t)[np.arange(len(check)), right] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    best = _softmax(logits / temperature)
    top, hit = best.max(axis=1), best.argmax(axis=1) == right
    order = np.argsort(-top)
    share = np.cumsum(hit[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= ACCEPTED_ACCURACY)
    reject = float(top[order][good[-1]]) if len(good) else 1.0
    return Model(langs, (embed @ weight).astype(np.float64), bias.astype(np.float64), temperature, reject)


def sample(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> list[tuple]:
    """Features of the bounded training sample."""
    usable = docs.select("doc_id", "text", "lang").where(
        (fold(folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return []
    whole = max(SAMPLE, PER_LANG * len(sizes))
    # Languages with fewer rows than an equal part give all; the others share what is left.
    left, part = whole, {}
    for k, r in enumerate(reversed(sizes)):
        part[r["lang"]] = min(r["count"], left // (len(sizes) - k))
        left -= part[r["lang"]]
    # More are drawn than wanted, so that hardly any draw falls short.
    share = F.create_map(*(F.lit(v) for r in sizes for v in (
        r["lang"], (1.2 * part[r["lang"]] + 30) / r["count"])))
    wanted = F.create_map(*(F.lit(v) for x in part.items() for v in x))
    luck = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    drawn = usable.where(luck < share[F.col("lang")]).withColumn("luck", luck)
    # Only the bounded draw is ranked.
    by_luck = Window.partitionBy("lang").orderBy("luck", "doc_id")
    counted = drawn.withColumn("rank", F.row_number().over(by_luck)).where(
        F.col("rank") <= wanted[F.col("lang")]).orderBy("luck", "doc_id").limit(whole).select("lang", "text")
    # Texts are shuffled for the order only within the sample.
    rows = counted.mapInArrow(_counts, "lang string, bucket array<int>, times array<int>").toArrow()
    lang, bucket, times = (rows.column(k).combine_chunks() for k in range(3))
    return [(lang[i].as_py(), bucket[i].values.to_numpy(), times[i].values.to_numpy())
            for i in range(len(rows))]


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for rows (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                n = len(piece.bounds) - 1
                rows = batch.slice(piece.begin, n)
                known = has_letter(piece) & (model is not None)
                if model is None:
                    best, score, reject = np.zeros(n, int), np.zeros(n), 1.0
                else:
                    p = model.scores(piece)
                    best, score, reject = p.argmax(axis=1), p.max(axis=1), model.reject_below
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), rows.column("held_out"),
                    pa.array([model.langs[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0)), pa.array(known & (score >= reject)),
                ], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.mapInArrow(run, PREDICTED)


def identify(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Learn from the folds that are not held out, and predict all rows of ``docs``."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(sample(docs, folds, held_out))
    return predict(docs.select(
        "doc_id", F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out"), "text"), model)
