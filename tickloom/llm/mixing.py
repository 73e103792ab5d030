"""Mixing sources to target weights, in blocks of fixed length.

The words of each source, document after document, are packed into blocks of
``BLOCK`` words. The mix is a sequence of output shards; how many blocks of
each source a shard takes is a multinomial draw, made group by group of shards
under the condition that a group's totals add up to the source's target
(so that the whole mix meets it, which free draws would only do on average).
The n-th slot of a source takes the block ``permutation(n)``, a keyed
permutation of the source's block numbers, run through again in another order
when all are used. Slots and blocks are joined by source and block number.

No window runs over a source: documents lie in buckets by a hash of their id,
and only bucket totals are summed up along the source. A seed fixes all draws,
so that reruns agree.

Results for unusual rows: NULL texts and those without words have size 0 and
are never taken. NULL is a source of its own, the last. Rows that repeat a
doc_id have a share each; of rows equal in doc_id and text either may get the
larger one, and ``mixed`` returns them as one. Other columns are ignored by
``takes`` and carried by ``mixed``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.anchors import U64, mix
from tickloom.llm.repeats import rewritten
from tickloom.llm.texts import in_small_batches, pieces, unused, words
from tickloom.session import write_and_reread

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BLOCK = 64
SHARD_SLOTS = 4096
GROUP_SHARDS = 16
#: Documents of a bucket, on average.
BUCKET = 2000
SEED = 7


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words in place of the text."""
    for batch in batches:
        found = [np.diff(words(p).bounds) for p in pieces(batch.column("text"))]
        size = np.concatenate(found) if found else np.zeros(0, np.int64)
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(size)], [*keep, "size"])


def targets(sources: DataFrame) -> DataFrame:
    """``target`` for rows (source, source_size), one for each source.

    Weights repeat in the order of the sources' names. A source stops at
    ``MOST`` times its size; what is over goes to the others by weight. Those
    that stop are the ones with the least size for their weight, so running
    sums in that order give the level of the others directly.
    """
    whole = Window.partitionBy()
    by_name = whole.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = whole.orderBy(F.col("source_size") / F.col("weight"), "number")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)),
                          (F.pmod(F.col("number"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = (
        sources.withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        # The level of all others if the sources before this one stop.
        .withColumn("level", (F.sum("source_size").over(whole) * TOTAL - stopped)
                    / (F.sum("weight").over(whole) - used)))
    free = F.col("level") * F.col("weight") <= F.col("source_size") * MOST
    first = F.min(F.when(free, F.struct("ratio", "number", "level"))).over(whole)
    return ranked.withColumn("first", first).select(
        "source", "source_size", "number", F.least(
            F.col("first.level") * F.col("weight"),
            (F.col("source_size") * MOST).cast("double")).alias("target"))


def permuted(
    index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False,
) -> np.ndarray:
    """Keyed permutation of 0 .. size - 1, for arrays of any sizes and keys.

    Four Feistel rounds over an even number of bits; what falls outside is sent
    through again until it falls inside.
    """
    bits = np.ceil(np.log2(np.maximum(size, 2) + 1e-9)).astype(np.int64)
    shift = np.maximum((bits + 1) // 2, 1).astype(U64)
    mask = (U64(1) << shift) - U64(1)
    out, size = index.astype(U64), size.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        s, m, k = shift[todo], mask[todo], key[todo] * U64(4)
        left, right = out[todo] >> s, out[todo] & m
        for r in (3, 2, 1, 0) if inverse else (0, 1, 2, 3):
            if inverse:
                left, right = right ^ (mix(left + k + U64(r)) & m), left
            else:
                left, right = right, left ^ (mix(right + k + U64(r)) & m)
        out[todo] = (left << s) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _keys(seed: int, number: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """A key for each source and pass over it."""
    return mix(mix(np.asarray(number).astype(U64) + U64(seed)) + np.asarray(turn).astype(U64))


class Quota(NamedTuple):
    """What the mix takes of a source: ``slots`` blocks, of the last one ``last`` words."""

    number: int
    size: int
    blocks: int
    slots: int
    last: int


def quota(number: int, size: int, target: float, block: int, seed: int) -> Quota:
    """Whole passes over the source, then as many blocks as the rest of the target needs."""
    want = min(round(target), MOST * size)
    if not want:
        return Quota(number, size, math.ceil(size / block), 0, 0)
    blocks = math.ceil(size / block)
    passes, rest = divmod(want, size)
    if not rest:
        return Quota(number, size, blocks, passes * blocks, block)
    missing = blocks * block - size  # words that the short block at the end lacks
    at = int(permuted(np.array([blocks - 1]), np.array([blocks]),
                      _keys(seed, np.array([number]), np.array([passes])), inverse=True)[0])
    words_of = lambda k: k * block - missing * (at < k)
    n = math.ceil(rest / block)
    while words_of(n) < rest:
        n += 1
    return Quota(number, size, blocks, passes * blocks + n, rest - words_of(n - 1))


def _draws(quotas: list[Quota], shards: int, seed: int, block: int):
    """Slots of the shards of each group: shard, source number, block number, words."""
    number, size, blocks, slots, last = (np.array(c, np.int64) for c in zip(*quotas))
    groups = math.ceil(shards / GROUP_SHARDS)

    def slots_of(shard: int, source: np.ndarray, slot: np.ndarray) -> pd.DataFrame:
        turn, index = np.divmod(slot, blocks[source])
        at = permuted(index, blocks[source], _keys(seed, number[source], turn))
        n = np.minimum(block, size[source] - at * block)
        n = np.where(slot == slots[source] - 1, np.minimum(last[source], n), n)
        return pd.DataFrame({"shard": np.full(len(slot), shard), "number": number[source],
                             "slot": slot, "turn": turn, "block": at, "words": n})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in (g for frame in frames for g in frame["id"].tolist()):
            rng = np.random.default_rng([seed, group])
            at = np.array([q.slots * group // groups for q in quotas], np.int64)
            left = np.array([q.slots * (group + 1) // groups for q in quotas], np.int64) - at
            first = group * GROUP_SHARDS
            for shard in range(first, min(first + GROUP_SHARDS, shards)):
                n = int(left.sum()) // (min(first + GROUP_SHARDS, shards) - shard)
                take = rng.multivariate_hypergeometric(left, n, method="marginals")
                source = np.repeat(np.arange(len(take)), take)
                slot = np.repeat(at - np.cumsum(take) + take, take) + np.arange(n)
                left, at = left - take, at + take
                yield slots_of(shard, source, slot)

    return run


class Mix:
    """One mix of a corpus.

    ``sized``: documents with source, size and target; ``parts``: words of
    documents (``begin`` to ``end``) with the shard and slot that take them.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = SEED):
        spark = in_small_batches(docs).sparkSession
        copy = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("copy")
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, copy long, size long"
        sized = write_and_reread(
            docs.select("doc_id", F.col("source").cast("string"), copy, "text").mapInArrow(sizes, schema))
        counted = write_and_reread(sized.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count("*").alias("n")))
        totals = write_and_reread(targets(counted.select("source", "source_size")))
        by_source = totals.join(
            counted.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s")))
        joined = sized.withColumnRenamed("source", "own").join(
            by_source.drop("s"), F.col("own").eqNullSafe(F.col("source"))).drop("own")

        # A document's place: its bucket, and its row in the bucket.
        bucket = F.pmod(F.xxhash64("doc_id", "copy"), F.ceil(F.col("n") / BUCKET).cast("long"))
        inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "copy")
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        self.sized = write_and_reread(
            joined.withColumn("bucket", bucket).withColumn("row", F.row_number().over(inside))
            .withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("n"))
        along = Window.partitionBy("number").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1)
        starts = self.sized.groupBy("number", "bucket").agg(F.sum("size").alias("size")).select(
            "number", "bucket", F.coalesce(F.sum("size").over(along), F.lit(0)).alias("base"))
        start, end = F.col("base") + F.col("ahead"), F.col("base") + F.col("ahead") + F.col("size")
        blocks = (
            self.sized.where("size > 0").join(starts, ["number", "bucket"])
            .select("number", "bucket", "row", "doc_id", "copy", start.alias("start"), end.alias("end"))
            .withColumn("block", F.explode(F.expr(
                f"sequence(start div {block}, (end - 1) div {block})"))))

        quotas = [quota(r["number"], r["source_size"], r["target"], block, seed)
                  for r in totals.where("source_size > 0").collect()]
        shards = max(1, math.ceil(sum(q.slots for q in quotas) / SHARD_SLOTS))
        groups = math.ceil(shards / GROUP_SHARDS) if quotas else 0
        slots = spark.range(0, groups, 1, max(1, min(groups, 10_000))).mapInPandas(
            _draws(quotas or [Quota(0, 0, 1, 0, 0)], shards, seed, block),
            "shard long, number int, slot long, turn long, block long, words long")
        begin = F.greatest("start", F.col("block") * block)
        stop = F.least("end", F.col("block") * block + F.col("words"))
        # Spark takes the slots for as few as the groups; they must not be broadcast.
        self.parts = slots.hint("merge").join(blocks, ["number", "block"]).select(
            "number", "bucket", "row", "doc_id", "copy", "shard", "slot", "turn",
            (begin - F.col("start")).alias("begin"), (stop - F.col("start")).alias("end"),
        ).where("end > begin")


def takes(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row for each row of ``docs``."""
    mix_ = Mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), block, seed)
    place = ["number", "bucket", "row"]
    taken = mix_.parts.groupBy(*place).agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    return mix_.sized.join(taken, place, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts made of their taken parts; parts that follow each other stay together."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            found = words(piece)
            out = []
            lists = batch.column(batch.num_columns - 1).slice(piece.begin, piece.end - piece.begin).to_pylist()
            for i, parts in enumerate(lists):
                runs: list[list[int]] = []
                for _, begin, end in sorted(tuple(p.values()) for p in parts):
                    if runs and runs[-1][1] == begin:
                        runs[-1][1] = end
                    else:
                        runs.append([begin, end])
                first, n = found.bounds[i], found.bounds[i + 1] - found.bounds[i]
                whole = piece.data[piece.bounds[i]:piece.bounds[i + 1]]
                out.append("\n".join(
                    (whole if (a, b) == (0, n) else
                     piece.data[found.start[first + a]:found.end[first + b - 1]]).tobytes().decode()
                    for a, b in runs))
            yield rewritten(batch, piece, out)


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``docs`` with the words that the mix takes of each, repeats included.

    Parts are put in the document's order, pass by pass. Documents of which
    nothing is taken are not in the mix. ``n_chars``, if there, follows the text.
    """
    mix_ = Mix(docs, block, seed)
    own, doc, copy, parts = (unused(docs, c) for c in ("_own", "_doc", "_copy", "_parts"))
    by_text = mix_.parts.groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("turn", "begin", "end"))).toDF(doc, copy, parts)
    texts = docs.withColumn(own, F.xxhash64("text"))
    if mix_.sized.groupBy("doc_id", "copy").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", own])
    return (
        texts.join(by_text, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(copy)))
        .drop(own, doc, copy).mapInArrow(_texts, docs.schema))
