"""A stored word index that takes changes in batches, as a table or as a stream.

Two plain tables, both by ``segment``: ``postings`` (term, doc_id, tf, doc_len) and
``docs`` (doc_id, doc_len; a NULL length is a tombstone). A batch of changes writes
a segment of its own and reads nothing of the others, so that its cost is that of the
words it changes. What a segment says of a document hides what earlier ones say. A
segment counts once its part of ``docs``, which is written last, is complete.

A batch that is written again replaces its own segment by the same rows. Small segments
are merged as they pile up: the newest one takes in those before it while they are not
much larger than all it has taken so far, so a posting is rewritten a number of times
that grows with the logarithm of the index, and so does the number of segments. A merge
writes a segment of a new number, and deletes the old ones afterwards; until then they
are hidden by it, as each of their documents stands in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom import settings as S
from tickloom.operators.search import build_postings, search_postings
from tickloom.schemas import flat
from tickloom.session import write_and_reread

POSTINGS = flat("segment long, term string, doc_id long, tf long, doc_len int")
DOCS = flat("segment long, doc_id long, doc_len int")
#: Numbers between the segments of two batches, for what is merged meanwhile.
BATCH = 1 << 20
#: A segment is merged with the newer ones if it has at most this many times their documents.
GROWTH = 2


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segments that are complete; few, whatever the size of the index."""
    files, where = _folder(spark, f"{path}/docs")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("segment=")
                  and files.exists(_folder(spark, f"{path}/docs/{n}/_SUCCESS")[1]))


def _read(spark: SparkSession, path: str, name: str, which: Sequence[int]) -> DataFrame:
    schema = POSTINGS if name == "postings" else DOCS
    if not which:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.names).where(
        F.col("segment").isin(list(which)))


def _drop(spark: SparkSession, path: str, segment: int) -> None:
    for name in ("docs", "postings"):
        files, where = _folder(spark, f"{path}/{name}/segment={segment}")
        files.delete(where, True)


def _store(postings: DataFrame, docs: DataFrame, path: str, segment: int) -> None:
    """Make these the rows of a segment. Postings are sorted by term, so that a lookup
    reads few row groups."""
    _drop(postings.sparkSession, path, segment)
    for rows, name, order in ((postings, "postings", ["term", "doc_id"]), (docs, "docs", ["doc_id"])):
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/{name}/segment={segment}")


def _not_hidden(rows: DataFrame, docs: DataFrame, which: Sequence[int]) -> DataFrame:
    """``rows`` of which no later segment speaks. The oldest segment hides nothing and
    is not looked at, so the side that is joined is as large as the changes."""
    if len(which) < 2:
        return rows
    later = docs.where(F.col("segment") > min(which)).groupBy(F.col("doc_id").alias("known")).agg(
        F.max("segment").alias("latest"))
    return rows.join(
        later, (F.col("doc_id") == F.col("known")) & (F.col("segment") < F.col("latest")), "left_anti")


def live_postings(spark: SparkSession, path: str) -> DataFrame:
    """The index as it stands: (term, doc_id, tf, doc_len). A filter on ``term`` reaches the scan."""
    which = segments(spark, path)
    kept = _not_hidden(_read(spark, path, "postings", which), _read(spark, path, "docs", which), which)
    return kept.select("term", "doc_id", "tf", "doc_len")


def live_stats(spark: SparkSession, path: str) -> DataFrame:
    """Number of documents and their average length in words: one row, from two narrow columns."""
    which = segments(spark, path)
    docs = _not_hidden(_read(spark, path, "docs", which), _read(spark, path, "docs", which), which)
    return docs.where("doc_len IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def write_changes(
    changes: DataFrame, path: str, batch: int, order_by: str | None = None, text: str = "summary",
) -> None:
    """Store a batch of changes ``(id, action, <text>)`` as a segment.

    ``action`` is insert, update or delete. Of several changes of one id the last by
    ``order_by`` counts (of equals, or without one, a fixed one). Batches are numbers that
    grow with time; the same number again replaces the segment. Changes without id are left out.
    """
    spark = changes.sparkSession
    by = [F.desc(order_by)] if order_by else []
    last = Window.partitionBy("id").orderBy(*by, F.col("action") == "delete", F.xxhash64("action", text))
    kept_text = F.when(F.col("action") != "delete", F.coalesce(F.col(text), F.lit("")))
    newest = write_and_reread(
        changes.where("id IS NOT NULL").withColumn("_row", F.row_number().over(last)).where("_row = 1")
        .select(F.col("id").cast("long").alias("id"), "action", kept_text.alias(text)))
    postings = write_and_reread(build_postings(newest.where("action <> 'delete'"), text))
    lengths = postings.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    docs = newest.withColumnRenamed("id", "doc_id").join(lengths, "doc_id", "left").select(
        "doc_id", F.when(F.col("action") != "delete", F.coalesce("doc_len", F.lit(0))).alias("doc_len"))
    # Segments of earlier batches are merged now: theirs are never written again.
    merge_small(spark, path, before=(batch + 1) * BATCH)
    _store(postings, docs, path, (batch + 1) * BATCH)


def merge_small(spark: SparkSession, path: str, before: int | None = None, growth: float = GROWTH) -> list[int]:
    """Merge the newest segments (of those numbered below ``before``) as far as it is worth
    while; returns what was merged. Only the one that writes batches may do so."""
    which = [s for s in segments(spark, path) if before is None or s < before]
    n_docs = {r["segment"]: r["n"] for r in _read(spark, path, "docs", which).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    taken, total = [], 0
    for segment in reversed(which):
        if taken and n_docs.get(segment, 0) > growth * total:
            break
        taken.append(segment)
        total += n_docs.get(segment, 0)
    if len(taken) < 2:
        return []
    docs = _read(spark, path, "docs", taken)
    postings = _not_hidden(_read(spark, path, "postings", taken), docs, taken).drop("segment")
    # A tombstone of the oldest segment of all has nothing left to hide.
    useful = F.col("doc_len").isNotNull() | (F.col("segment") > which[0])
    _store(postings, _not_hidden(docs, _read(spark, path, "docs", taken), taken).where(useful).drop("segment"),
           path, taken[0] + 1)
    for segment in taken:
        _drop(spark, path, segment)
    return taken


def follow_changes(
    changes: DataFrame, path: str, checkpoint: str, order_by: str | None = None, text: str = "summary",
    seconds: float | None = S.TICK_SECONDS,
) -> StreamingQuery:
    """Keep the index at ``path`` up to date with a stream of changes.

    Micro-batches are batches 0, 1, ...; -1 is free for an index made beforehand
    (``write_changes`` of all documents as inserts). A micro-batch that runs again writes
    the same segment again. With ``seconds=None`` all changes that are there are taken and
    the query ends.
    """
    writer = changes.writeStream.foreachBatch(
        lambda batch, number: write_changes(batch, path, number, order_by, text)
    ).option("checkpointLocation", checkpoint)
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def search_index(
    spark: SparkSession, path: str, docs: DataFrame, terms: Sequence[str], limit: int = S.SEARCH_LIMIT,
) -> DataFrame:
    """``search.search`` over the stored index as it stands; ``docs`` are the documents by ``id``."""
    return search_postings(live_postings(spark, path), docs, live_stats(spark, path), terms, limit)
