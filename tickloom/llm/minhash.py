"""Near-duplicate groups: MinHash, banding, verification, connected components.

Texts with equal shingle sets form a *class*, which its least doc_id stands
for. Classes get 128 minima of universal hashes in 32 bands of 4; two classes
of similarity 0.8 share no band with probability 5e-8. Pairs are first verified
on the signatures (those that agree on fewer than 62 % cannot be links but with
probability 2e-7), then on the full sets.

A band value shared by many classes is not expanded into pairs. Every class is
first compared with the least class of each of its bands. Then bands that still
hold several components are looked at: those with the same largest component
are taken together, and their classes are compared across components inside
tasks, in cells of bounded size. A task only returns links, and stops comparing
what it has already joined. Nothing is capped.

Results for unusual rows: NULL and empty texts have no shingles and link with
nothing; so do rows with NULL doc_id, whose component is NULL and which are
kept. Rows that share a doc_id are one node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.anchors import BASE, U64, mix
from tickloom.llm.components import components
from tickloom.llm.texts import Piece, in_small_batches, lower, pieces, word_hashes, words
from tickloom.session import write_and_reread

BANDS, ROWS = 32, 4
SHINGLE = 5
PERCENT = 80
#: Least share of equal minima for a pair to be looked at on full sets.
ESTIMATE = 0.62
#: Classes of a block, and their shingles, on average; a cell compares two blocks.
CELL, CELL_SHINGLES = 2000, 2_000_000
#: Low bits of shingles that are looked up first.
_LOW = 1 << 20

_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(piece: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their bounds."""
    data = lower(piece.data)
    found = words(piece)
    codes, bounds = word_hashes(data, found), found.bounds
    n = np.diff(bounds)
    # A text with fewer words than a shingle is one shingle of all its words.
    step = np.arange(len(codes))
    left = np.repeat(bounds[1:], n) - step
    short = np.repeat(n < size, n)
    out = np.zeros(len(codes), U64)
    for k in range(size):
        part = mix(np.roll(codes, -k) + U64(BASE * (k + 1) % (1 << 64)))
        out += np.where(left > k, part, U64(0))
    out = mix(out)
    use = (left >= size) | (short & (step == np.repeat(bounds[:-1], n)))
    text = np.repeat(np.arange(len(n)), n)[use]
    out = out[use]
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[keep], np.searchsorted(text[keep], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes, a row for each text that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), len(_A)), np.uint32)
    for i, (a, b) in enumerate(zip(_A, _B)):
        values = ((sets * a + b) >> U64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(values, starts)
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                sets, bounds = shingle_sets(piece, size)
                n = np.diff(bounds)
                signs = iter(signatures(sets, bounds)) if n.any() else iter(())
                names = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a
                         else None for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(piece.begin, len(n)), pa.array(n),
                    pa.array(names, pa.binary()),
                    pa.array([next(signs).tobytes() if k else None for k in n], pa.binary()),
                ], ["doc_id", "n_shingles", "class", "sign"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                sets, bounds = shingle_sets(piece, size)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(piece.begin, piece.end - piece.begin),
                    pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])],
                             pa.binary()),
                ], ["node", "shingles"])

    return run


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Equal-sized binary values as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        sign = _matrix(batch.column("sign"), np.uint32).astype(U64).reshape(-1, BANDS, ROWS)
        value = np.arange(BANDS, dtype=U64)[None, :] * U64(BASE) + np.zeros((len(batch), 1), U64)
        for k in range(ROWS):
            value = mix(value + sign[:, :, k])
        yield pa.RecordBatch.from_arrays([
            pa.array(value.reshape(-1).view(np.int64)),
            pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)),
        ], ["band", "node"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            same = (_matrix(batch.column("sign_a"), np.uint32)
                    == _matrix(batch.column("sign_b"), np.uint32)).mean(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= ESTIMATE))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_linked(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), percent)
                    for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class _Cell:
    """Classes of one cell: compares those of different components."""

    def __init__(self, rows: list[tuple], percent: int):
        self.percent = percent
        node, component, asks, sign, sets = zip(*rows)
        self.node, self.asks = np.array(node), np.array(asks, bool)
        _, self.root = np.unique(np.array(component), return_inverse=True)
        self.sign = np.frombuffer(b"".join(sign), np.uint8).reshape(len(rows), -1)
        self.sets = [np.frombuffer(x, U64) for x in sets]
        self.size = np.array([len(x) for x in self.sets])
        self.start = np.cumsum(self.size) - self.size
        self.low = (np.concatenate(self.sets) & U64(_LOW - 1)).astype(np.int32)

    def links(self) -> Iterator[tuple[int, int]]:
        seen = np.zeros(_LOW, bool)
        for i in np.flatnonzero(self.asks):
            other = np.flatnonzero(~self.asks & (self.root != self.root[i]))
            if not len(other):
                continue
            alike = (self.sign[other] == self.sign[i]).mean(axis=1)
            other, alike = other[alike >= ESTIMATE], alike[alike >= ESTIMATE]
            if not len(other):
                continue
            # Equal low bits bound the intersection from above.
            mine = self.low[self.start[i]:self.start[i] + self.size[i]]
            seen[mine] = True
            n = self.size[other]
            at = np.repeat(self.start[other] - np.cumsum(n) + n, n) + np.arange(n.sum())
            bound = np.add.reduceat(seen[self.low[at]].astype(np.int64), np.cumsum(n) - n)
            seen[mine] = False
            able = 100 * bound >= self.percent * (n + self.size[i] - bound)
            for j in other[able][np.argsort(-alike[able], kind="stable")]:
                if self.root[j] != self.root[i] and _linked(
                        self.sets[i], self.sets[j], self.percent):
                    self.root[self.root == self.root[j]] = self.root[i]
                    yield int(self.node[i]), int(self.node[j])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _cells(percent: int):
    """Links across components; the rows of a cell follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, row in zip(
                zip(*(batch.column(c).to_pylist() for c in ("main", "i", "j"))),
                zip(*(batch.column(c).to_pylist()
                      for c in ("node", "component", "asks", "sign", "shingles"))),
            ):
                if key != held and rows:
                    found += _Cell(rows, percent).links()
                    rows = []
                held = key
                rows.append(row)
            yield _pair_batch(found)
        if rows:
            yield _pair_batch(list(_Cell(rows, percent).links()))

    return run


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


class _Search:
    """Links between the classes of one corpus, found step by step."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.percent = percent
        in_small_batches(docs)
        base = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
        self.signed = write_and_reread(base.mapInArrow(
            _sign(size), "doc_id long, n_shingles long, class binary, sign binary"))
        some = self.signed.where("class IS NOT NULL")
        first = some.groupBy("class").agg(F.min("doc_id").alias("node"))
        self.members = write_and_reread(
            some.select("doc_id", "class").join(first, "class").select("doc_id", "node").distinct())
        heads = self.members.where("doc_id = node").select("node")
        self.nodes = write_and_reread(
            some.select(F.col("doc_id").alias("node"), "sign")
            .join(heads, "node", "left_semi").dropDuplicates(["node"]))
        bands = self.nodes.mapInArrow(_band, "band long, node long")
        least = bands.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n"))
        #: Bands that several classes share.
        self.bands = write_and_reread(bands.join(least.where("n > 1"), "band"))
        used = self.bands.select("node").distinct()
        self.sets = write_and_reread(
            base.withColumnRenamed("doc_id", "node").join(used, "node", "left_semi")
            .dropDuplicates(["node"]).withColumnRenamed("node", "doc_id")
            .mapInArrow(_sets(size), "node long, shingles binary"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        for side in ("a", "b"):
            pairs = pairs.join(self.nodes.select(
                F.col("node").alias(side), F.col("sign").alias(f"sign_{side}")), side)
        pairs = write_and_reread(pairs.mapInArrow(_likely, "a long, b long"))
        for side in ("b", "a"):
            pairs = pairs.join(self.sets.select(
                F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        return pairs.mapInArrow(_confirm(self.percent), "a long, b long")

    def run(self) -> DataFrame:
        """(node, component) of every node that has a link."""
        links = write_and_reread(self.verified(self.bands.where("node <> head").select(
            F.col("head").alias("a"), F.col("node").alias("b"))))
        tree = components(links)

        # Bands that still hold several components, by the largest of them.
        placed = self.bands.select("band", "node").join(tree, "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
        parts = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
        several = parts.groupBy("band").agg(
            F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")
        ).where("parts > 1").select("band", F.col("top.component").alias("main"))
        rows = write_and_reread(
            placed.join(several, "band").select("main", "node", "component").distinct())

        # Classes outside the largest component ask all members; a cell is a
        # block of those that ask and a block of members.
        outside = F.col("component") != F.col("main")
        def blocks(of: Column) -> Column:
            many = F.ceil(F.count_if(of) / CELL)
            large = F.ceil(F.sum(F.when(of, F.col("n"))) / CELL_SHINGLES)
            return F.greatest(many, large).cast("long")

        rows = rows.join(self.sets.select("node", (F.octet_length("shingles") / 8).alias("n")), "node")
        # Stored, so that the join with it can be split where one component is very large.
        sizes = write_and_reread(rows.groupBy("main").agg(
            blocks(F.lit(True)).alias("blocks"), blocks(outside).alias("asking")))
        sized = rows.join(sizes, "main")

        def block(n: str) -> Column:
            return F.pmod(F.xxhash64("node"), F.col(n))

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

        members = sized.select("main", every("asking").alias("i"), block("blocks").alias("j"),
                               "node", "component", F.lit(False).alias("asks"))
        askers = sized.where(outside).select(
            "main", block("asking").alias("i"), every("blocks").alias("j"),
            "node", "component", F.lit(True).alias("asks"))
        cells = members.unionByName(askers)
        more = (
            cells.join(self.nodes.mapInArrow(_narrow, "node long, sign binary"), "node")
            .join(self.sets, "node").repartition("main", "i", "j")
            .sortWithinPartitions("main", "i", "j")
            .mapInArrow(_cells(self.percent), "a long, b long"))
        # The tree says as much as the links it was made of.
        known = tree.where("node <> component").select(
            F.col("node").alias("a"), F.col("component").alias("b"))
        return components(known.unionByName(more))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest byte of each minimum."""
    for batch in batches:
        if len(batch):
            low = _matrix(batch.column("sign"), np.uint32).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([x.tobytes() for x in low], pa.binary())],
                ["node", "sign"])


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    search = _Search(docs, size, percent)
    tree = search.run()
    placed = search.members.join(
        tree.withColumnRenamed("component", "found"), "node", "left").select(
        "doc_id", F.coalesce("found", "node").alias("component")).groupBy("doc_id").agg(
        F.min("component").alias("component"))
    whole = search.signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id IS NULL").mapInArrow(
        _sign(size), "doc_id long, n_shingles long, class binary, sign binary").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.unionByName(nameless).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that have a near-duplicate of smaller doc_id, all columns kept."""
    gone = groups(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
