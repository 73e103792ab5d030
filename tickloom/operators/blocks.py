"""Ranked search that leaves out blocks of postings that cannot reach the best hits.

Postings of a term stand in blocks, one for each range of document ids; ranges are the same
for all terms. A block knows the largest count and the shortest document in it, and so an
upper bound of what any of its postings adds to a score. A search reads the narrow columns of
the blocks of its terms, scores the most promising blocks first, and then only those whose
bounds add up to the score of the last hit so far. Blocks of a term are stored by falling
weight, so that the filter on the weight skips whole row groups.

Ranks are those of ``search.search``. Words are looked up as they are; for words that end
in ``*`` all postings are wanted, see ``search.search_postings``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import settings as S
from tickloom.functions.text import fold
from tickloom.operators.search import B, K1, LEAST_IDF, _bm25, _nothing, _units, fetch

#: Document ids of a range.
SPAN = 1024


def _weight(tf: Column, length: Column, average: Column) -> Column:
    """What a posting adds to a score, but for factors of its term."""
    return tf / (tf + K1 * (1 - B + B * length / average))


def build_blocks(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """Postings (term, doc_id, tf, doc_len) in blocks: (term, block, n, max_tf, min_len,
    average, weight, entries). A block holds at most ``span`` postings.

    Postings are read several times: give stored ones. They are dealt out in ranges of
    (term, block), in which blocks are then made and may be written."""
    average = postings.select("doc_id", "doc_len").distinct().agg(F.avg("doc_len").alias("average")).scalar()
    placed = postings.withColumn("block", F.floor(F.col("doc_id") / span)).repartitionByRange("term", "block")
    blocks = placed.groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"),
        F.collect_list(F.struct("doc_id", "tf", "doc_len")).alias("entries"))
    return blocks.withColumn("average", average).select(
        "term", "block", "n", "max_tf", "min_len", "average",
        _weight(F.col("max_tf"), F.col("min_len"), F.col("average")).alias("weight"), "entries")


def write_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store blocks, in the ranges of terms that ``build_blocks`` gives them in, by term and
    falling weight in each file."""
    blocks.sortWithinPartitions("term", F.desc("weight"), "block").write.mode(mode).parquet(path)


class _Query(NamedTuple):
    """What the driver knows of a search: one small row for each word."""

    words: list[str]
    containing: list[int]
    heaviest: list[float]
    n_docs: int
    average: float
    built: float   # average length when the blocks were made

    def idf(self, i: int) -> Column:
        raw = F.log((F.lit(self.n_docs) - self.containing[i] + 0.5) / (F.lit(self.containing[i]) + 0.5))
        return F.when(raw <= 0, LEAST_IDF).otherwise(raw)

    def part(self, i: int, tf: Column, length: Column) -> Column:
        """What a word adds to a document's score."""
        return _bm25(tf, F.lit(self.containing[i]), F.lit(self.n_docs), length, F.lit(self.average))


def _scored(blocks: DataFrame, query: _Query) -> DataFrame:
    """(id, score) of documents in these blocks that have all words."""
    rows = blocks.select("term", F.inline("entries"))
    counts = rows.groupBy("doc_id", "doc_len").agg(*(
        F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"_f{i}")
        for i, w in enumerate(query.words)))
    for i in range(len(query.words)):
        counts = counts.where(F.col(f"_f{i}") > 0)
    score = sum((query.part(i, F.col(f"_f{i}"), F.col("doc_len")) for i in range(len(query.words))), F.lit(0.0))
    return counts.select(F.col("doc_id").alias("id"), score.alias("score"))


def _promising(blocks: DataFrame, query: _Query) -> DataFrame:
    """(block, bound): ranges in which all words occur, from narrow columns only."""
    heads = blocks.select("term", "block", "max_tf", "min_len")
    sides = heads.groupBy("block").agg(*(
        F.max(F.when(F.col("term") == w, query.part(i, F.col("max_tf"), F.col("min_len")))).alias(f"_b{i}")
        for i, w in enumerate(query.words)))
    bound = sum((F.col(f"_b{i}") for i in range(len(query.words))), F.lit(0.0))
    return sides.select("block", bound.alias("bound")).where("bound IS NOT NULL")


def _asked(blocks: DataFrame, stats: DataFrame, terms: Sequence[str]) -> _Query | None:
    spark = blocks.sparkSession
    words: list[str] = []
    units = _units(terms)
    if units:
        folded = spark.range(1).select(*(fold(F.lit(word)).alias(f"w{i}") for i, (word, _) in enumerate(units))).first()
        words = list(folded)
    known = {r["term"]: r for r in blocks.where(F.col("term").isin(words)).groupBy("term").agg(
        F.sum("n").alias("n"), F.max("weight").alias("w"), F.max("average").alias("built")).collect()}
    if not words or any(w not in known for w in words):
        return None
    corpus = stats.select("n_docs", "avg_len").first()
    return _Query(words, [known[w]["n"] for w in words], [known[w]["w"] for w in words],
                  corpus["n_docs"], corpus["avg_len"], known[words[0]]["built"])


def wanted_blocks(blocks: DataFrame, query: _Query, least: float) -> DataFrame:
    """Blocks of the words whose bounds add up to ``least``."""
    # Blocks were weighed by an older average; a longer one makes documents weigh at most so much more.
    grown = max(1.0, query.average / query.built)
    most = [F.lit(query.heaviest[i] * grown * (K1 + 1)) * query.idf(i) for i in range(len(query.words))]
    needs = blocks.sparkSession.range(1).select(*(
        ((F.lit(least) - sum((m for j, m in enumerate(most) if j != i), F.lit(0.0))) / (query.idf(i) * (K1 + 1) * grown))
        .alias(f"n{i}") for i in range(len(query.words)))).first()
    wide = F.lit(False)
    for word, need in zip(query.words, needs):
        wide = wide | ((F.col("term") == word) & (F.col("weight") >= need * (1 - 1e-9) if need > 0 else F.lit(True)))
    some = _promising(blocks.where(wide), query).where(F.col("bound") >= least * (1 - 1e-9)).select("block")
    return blocks.where(wide).join(some, "block", "left_semi")


def search_blocks(
    blocks: DataFrame, docs: DataFrame, stats: DataFrame, terms: Sequence[str], limit: int = S.SEARCH_LIMIT,
) -> DataFrame:
    """``search.search`` over stored blocks. ``stats`` is ``corpus_stats`` of the documents."""
    if any(prefix for _, prefix in _units(terms)):
        raise ValueError("words that end in * need all postings: search_postings")
    query = _asked(blocks, stats, terms)
    if query is None:
        return _nothing(docs)
    mine = blocks.where(F.col("term").isin(query.words))
    # As many ranges as hits are wanted, the most promising first; their last hit is the mark.
    first = _promising(mine, query).orderBy(F.desc("bound"), "block").limit(limit).select("block")
    begun = _scored(mine.join(F.broadcast(first), "block", "left_semi"), query)
    best = begun.orderBy(F.desc("score"), "id").limit(limit).agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    least = best["least"] if best["n"] == limit else 0.0
    hits = _scored(wanted_blocks(blocks, query, least), query)
    top = hits.select("id", (-F.col("score")).alias("rank")).orderBy("rank", "id").limit(limit)
    return fetch(docs, top)
