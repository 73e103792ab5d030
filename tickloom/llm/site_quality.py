"""Quality by hierarchical empirical Bayes: a document's evidence and its site's.

The share of good documents of a path is taken for a draw around its host's
share, that for a draw around the share of all. Both levels are beta
distributions; their strengths are estimated from the spread between hosts and
between the paths of hosts (method of moments), so that sparse sites are drawn to
the level above and well-known ones speak for themselves. Shares are grouped
counts over all labelled rows outside the held-out fold; a labelled document's
own label is left out of its site's share.

A logistic regression on counts of the text gives the document's evidence, a
second one weighs it against the site's posterior. They are fitted on a bounded
sample, ``SAMPLE`` labelled rows of each class drawn by a hash of the id.

Texts are read once and not shuffled; sites are joined to one small row for each
document, and a site with many of them is split by Spark.

Results for unusual rows: NULL and empty texts count as texts without words.
NULL hosts and paths are sites like others. Texts of any length are read whole,
each in one task. Rows with NULL doc_id are scored,
never learned from, not held out. Repeated rows are scored each for itself.
Labels that contradict each other, or are NULL, are not learned from; without
labels of both kinds every score is the share of good labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.language_id import fold
from tickloom.llm.quality_rules import base_counts, char_histograms
from tickloom.llm.texts import Piece, in_small_batches, pieces, word_hashes, words
from tickloom.llm.toxicity import _fit
from tickloom.session import write_and_reread

SAMPLE = 3000
FOLDS, HELD_OUT = 5, 3
THRESHOLD = 0.5
#: Least and greatest strength of a level, in documents.
STRENGTH = (1.0, 10_000.0)


def text_features(piece: Piece) -> np.ndarray:
    """What the document's classifier sees, a row for each text."""
    found = words(piece)
    count = base_counts(piece, found, word_hashes(piece.data, found))
    n = np.maximum(count["n_words"], 1)
    chars = char_histograms(piece)
    share = chars / np.maximum(chars.sum(axis=1, keepdims=True), 1)
    repeated = count["n_repeat_words"] / n
    lines = np.maximum(chars[:, 4], 1)
    return np.column_stack([
        np.log1p(count["n_words"]), count["n_words"] < 50, repeated, repeated > 0.5,
        count["n_dup_lines"] / lines, count["word_chars"] / n, share])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            x = text_features(piece)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(piece.begin, len(x)),
                pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: float, spread: float, noise: float) -> float:
    """Documents that a prior is worth, from the variance between shares beyond chance."""
    between = max(spread - noise, 1e-9)
    return float(np.clip(mean * (1 - mean) / between - 1, *STRENGTH))


def sites(marked: DataFrame) -> tuple[DataFrame, DataFrame, float, float, float]:
    """Counts of each host and of each path; the global share; strengths of hosts and paths.

    ``marked``: rows (host, path, good).
    """
    paths = write_and_reread(marked.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("good").alias("good")))
    hosts = write_and_reread(paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("g")).first()
    share = (total["g"] or 0) / total["n"] if total["n"] else 0.5
    joined = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")

    def spread(rows: DataFrame, n: str, good: str, around: Column) -> tuple[float, float]:
        rate = F.col(good) / F.col(n)
        r = rows.where(F.col(n) > 1).agg(
            (F.sum(F.col(n) * (rate - around) ** 2) / F.sum(n)).alias("v"),
            (F.sum(around * (1 - around)) / F.sum(n)).alias("e")).first()
        return (r["v"] or 0.0), (r["e"] or 0.0)

    of_hosts = _strength(share, *spread(hosts, "host_n", "host_good", F.lit(share)))
    of_paths = _strength(share, *spread(joined, "n", "good", F.col("host_good") / F.col("host_n")))
    return hosts, paths, share, of_hosts, of_paths


SCORED = ["doc_id", "held_out", "text_score", "host_share", "path_share", "score", "predicted"]


def scored(
    docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT,
) -> DataFrame:
    """Columns ``SCORED``, a row for each row of ``docs`` (doc_id, host, path, text).

    ``labels`` has (doc_id, quality). ``score`` is the probability of quality 1.
    """
    docs = in_small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "host", "path", "text")
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("good"), F.max("quality").alias("high"))
        .where("good = high").drop("high").where(fold(folds) != held_out))
    named = docs.select("doc_id", "host", "path").distinct().join(marks, "doc_id")
    hosts, paths, share, of_hosts, of_paths = sites(named)

    def posterior(rows: DataFrame) -> DataFrame:
        """Shares of host and path for rows (host, path, good), without the row's own label.

        A path without labels has its host's share, a host without labels that of all.
        """
        of_host = hosts.select(F.col("host").alias("h"), "host_n", "host_good")
        of_path = paths.select(F.col("host").alias("ph"), F.col("path").alias("p"), "n", F.col("good").alias("g"))
        own, one = F.coalesce("good", F.lit(0)), F.col("good").isNotNull().cast("int")
        k = {c: F.coalesce(c, F.lit(0)) for c in ("n", "g", "host_n", "host_good")}
        host = (k["host_good"] - own + of_hosts * share) / (k["host_n"] - one + of_hosts)
        return rows.join(of_host, F.col("host").eqNullSafe(F.col("h")), "left").join(
            of_path, F.col("host").eqNullSafe(F.col("ph")) & F.col("path").eqNullSafe(F.col("p")), "left",
        ).withColumn("host_share", host).withColumn(
            "path_share", (k["g"] - own + of_paths * F.col("host_share")) / (k["n"] - one + of_paths),
        ).drop("h", "ph", "p", "n", "g", "host_n", "host_good")

    total = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    weights = _learn(docs, marks, posterior) if len(total) == 2 else None

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                rows = batch.slice(piece.begin, piece.end - piece.begin)
                x = text_features(piece)
                value = np.zeros(len(x)) if weights is None else weights.text(x)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("doc_id", "host", "path")), pa.array(value)],
                    ["doc_id", "host", "path", "evidence"])

    base = docs.mapInArrow(evidence, "doc_id long, host string, path string, evidence double")
    whole = posterior(write_and_reread(base).join(marks, "doc_id", "left"))
    if weights is None:
        score = text_score = F.lit(float(share))
    else:
        text_score = 1 / (1 + F.exp(-F.col("evidence")))
        a, b, c = weights.mixing
        score = 1 / (1 + F.exp(-(a * F.col("evidence") + b * _logit(F.col("path_share")) + c)))
    return whole.select(
        "doc_id", F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out"),
        text_score.alias("text_score"), "host_share", "path_share", score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"))


class _Weights:
    """Weights of the text's features, and of text and site against each other."""

    def __init__(self, x: np.ndarray, y: np.ndarray, site: np.ndarray, w: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        # One half fits the text's weights, the other the mixing.
        half = np.arange(len(y)) % 2 == 0
        if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
            half = np.ones(len(y), bool)
        self.beta, self.bias = _fit((x[half] - self.mean) / self.scale, y[half], w[half])
        rest = ~half if not half.all() else half
        both = np.column_stack([self.text(x[rest]), site[rest]])
        (a, b), c = _fit(both, y[rest], w[rest])
        self.mixing = (float(a), float(b), float(c))

    def text(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.beta + self.bias, -30, 30)


def _learn(docs: DataFrame, marks: DataFrame, posterior) -> _Weights | None:
    luck = F.xxhash64("doc_id", F.lit("quality"))
    drawn = [marks.where(F.col("good") == k).orderBy(luck, "doc_id").limit(SAMPLE) for k in (0, 1)]
    # At most 2 * SAMPLE ids: small enough to be sent to every scan.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    features = docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id").mapInArrow(
        _featured, "doc_id long, x array<double>")
    site = posterior(docs.select("doc_id", "host", "path").join(chosen, "doc_id")).select(
        "doc_id", "good", _logit(F.col("path_share")).alias("site"))
    rows = features.dropDuplicates(["doc_id"]).join(
        site.dropDuplicates(["doc_id"]), "doc_id").orderBy("doc_id").collect()
    y = np.array([r["good"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    n = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    w = np.array([n[int(v)] / (y == v).sum() for v in y])
    return _Weights(np.array([r["x"] for r in rows]), y, np.array([r["site"] for r in rows]),
                    w * len(w) / w.sum())


def by_source(docs: DataFrame) -> DataFrame:
    """Documents with their source as host, and its part in one language as path."""
    return docs.select("doc_id", F.col("source").cast("string").alias("host"), F.concat_ws(
        "/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))).alias("path"), "text")
