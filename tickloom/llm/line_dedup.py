"""Line de-duplication: lines that many documents share are dropped.

Lines are exploded, normalised and hashed; Spark counts the distinct documents
of every hash; a line over the threshold goes from all documents but one, the
largest ``doc_id`` that holds it; what is left is put together by position.

Only built-in functions. What is shuffled is a hash of 128 bits for each line,
then the positions of the lines that go, and every text once, to meet the
positions of its own lines. A line in a third of all documents is counted by
(hash, document) first, which spreads it out, and looked up by a join that Spark
can split. No group is collected: a row gathers positions of its own lines only.

Results for unusual rows: a NULL text is one empty line and stays NULL in
``dedup``; so is an empty one. Lines end at ``\\n`` alone. A row with NULL doc_id
is no document of a line and keeps all its lines. Rows that share a doc_id are
one document: they count once, and lose or keep a line together. Equal lines
inside one document count once and go together. Texts of any length are looked
at whole, as arrays of their lines within one row. Empty tables give no rows.
Other columns are ignored by ``cuts`` and carried by ``dedup``, under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.texts import whole_rows
from tickloom.session import write_and_reread

#: Code points a key has at least, and documents that hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
_SPACE = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def key_hash(line: Column) -> Column:
    """128 bits of a line without white space around it, A-Z in lower case."""
    key = F.translate(_stripped(line), _UPPER, _LOWER)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(0), key).alias("b"))


def _keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, copy, at, a, b) of every line that is long enough."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", "copy", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    long = lines.where(F.length(_stripped(F.col("line"))) >= least_chars)
    return long.select("doc_id", "copy", "at", key_hash(F.col("line")).alias("key")).select(
        "doc_id", "copy", "at", "key.a", "key.b")


def shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(a, b, n_docs, last): hashes of lines in ``least_docs`` documents or more,
    and the largest doc_id that holds each."""
    return (
        _keys(docs.withColumn("copy", F.lit(0)), least_chars)
        .groupBy("a", "b")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last"))
        .where(F.col("n_docs") >= least_docs)
    )


def _reduced(rows: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``n_lines``, ``n_dropped`` and ``kept``, the other
    lines joined."""
    # Rows that share a doc_id may differ in text; equal rows have equal lines.
    rows = rows.withColumn("copy", F.xxhash64("text"))
    docs = rows.select("doc_id", "copy", "text")
    shared = write_and_reread(shared_lines(docs, least_chars, least_docs))
    gone = (
        _keys(docs, least_chars).join(shared, ["a", "b"]).where(F.col("doc_id") != F.col("last"))
        .groupBy("doc_id", "copy").agg(F.collect_set("at").alias("gone"))
    )
    here = rows.withColumn("lines", lines_of(F.col("text"))).join(gone, ["doc_id", "copy"], "left")
    n = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return here.withColumns({
        "n_lines": n.cast("long"),
        "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
        "kept": F.array_join(F.transform(stay, lambda at: F.get("lines", at)), "\n"),
    })


def cuts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): one row for each of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _reduced(rows, least_chars, least_docs).select("doc_id", "n_lines", "n_dropped", "kept")


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without the lines that go, all columns kept; ``n_chars``, if there, follows the text."""
    found = _reduced(whole_rows(docs), least_chars, least_docs)
    return found.select(*(
        F.when(F.col("n_dropped") > 0, new).otherwise(old).cast(field.dataType).alias(field.name)
        if new is not None else old.alias(field.name)
        for field in docs.schema.fields
        for old in [F.col("row").getField(field.name)]
        for new in [{"text": F.col("kept"), "n_chars": F.length("kept")}.get(field.name)]
    ))
