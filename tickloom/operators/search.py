"""Ranked word search, with and without a stored index."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import settings as S
from tickloom.functions.settle import settle
from tickloom.functions.text import fold, tokens
from tickloom.session import discard, write_and_reread

# Fixed values of the BM25 ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Column of a document table's parts, with their number at its end; the number by default.
PART, PARTS = "id_part_of_", 256
#: Up to so many ids are looked up by name.
FEW = 1000


def _units(terms: Sequence[str]) -> list[tuple[str, bool]]:
    """(word, is prefix) for each word of the query. A term may hold several
    words, as users type them; all are wanted. ``word*`` is a prefix."""
    units: list[tuple[str, bool]] = []
    for term in terms:
        word = ""
        for char in unicodedata.normalize("NFC", term) + " ":
            kind = unicodedata.category(char)[0]
            if kind in "LNM":
                word += char
                continue
            if word:
                units.append((word, char == "*"))
            word = ""
    return units


def _nothing(docs: DataFrame) -> DataFrame:
    return docs.select(*_plain(docs)).withColumn("rank", F.lit(0.0)).limit(0)


def _plain(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if not c.startswith(PART)]


def _folded(word: str) -> Column:
    return fold(F.lit(word))


def _matcher(word: str, is_prefix: bool) -> Callable[[Column], Column]:
    """Test of a term column against one unit of the query."""
    folded = _folded(word)
    return (lambda t: t.startswith(folded)) if is_prefix else (lambda t: t == folded)


def _bm25(frequency: Column, containing: Column, n_docs: Column, length: Column,
          average: Column) -> Column:
    raw = F.log((n_docs - containing + 0.5) / (containing + 0.5))
    idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    return idf * frequency * (K1 + 1) / (
        frequency + K1 * (1 - B + B * length / average)
    )


def corpus_stats(docs: DataFrame, text: str = "summary") -> DataFrame:
    """Number of documents and their average length in words: one row."""
    length = F.size(tokens(F.coalesce(F.col(text), F.lit(""))))
    return docs.select(text).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(length).alias("avg_len"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """In how many documents each term occurs."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def search(
    docs: DataFrame, terms: Sequence[str], limit: int = S.SEARCH_LIMIT, text: str = "summary"
) -> DataFrame:
    """Rows that contain all terms, best first (the lower ``rank`` the better).

    Texts are read and cut into words once: what that gives of a row, its id and some
    counts, is stored, and the corpus figures and the ranking come from there. Of the
    texts themselves only the hits are read again. Without any word in ``terms`` nothing
    is found.
    """
    units = _units(terms)
    if not units:
        return _nothing(docs)
    words = settle(docs.select("id", text), _words=tokens(F.coalesce(F.col(text), F.lit(""))))
    counted = write_and_reread(words.select("id", F.size("_words").alias("_len"), *(
        F.size(F.filter("_words", _matcher(*u))).alias(f"_f{i}") for i, u in enumerate(units))))
    # One row, taken in as a value.
    figures = counted.agg(F.struct(
        F.count(F.lit(1)).alias("docs"),
        F.avg("_len").alias("avg"),
        *(F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(units))),
    ).alias("figures")).scalar()
    hits = counted
    for i in range(len(units)):
        hits = hits.filter(F.col(f"_f{i}") > 0)
    figure = F.col("_figures")
    score = sum(
        (
            _bm25(F.col(f"_f{i}"), figure[f"n{i}"], figure["docs"], F.col("_len"), figure["avg"])
            for i in range(len(units))
        ),
        F.lit(0.0),
    )
    top = hits.withColumn("_figures", figures).select("id", (-score).alias("rank")).orderBy("rank", "id").limit(limit)
    return fetch(docs, top)


def _part(row_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int")


def write_documents(docs: DataFrame, path: str, parts: int = PARTS, mode: str = "errorifexists") -> None:
    """Store documents so that little is read for a few ids: in parts by id, sorted in each.
    A part may have many files; take as many parts as make them some tens of files."""
    name = f"{PART}{parts}"
    placed = docs.withColumn(name, _part(F.col("id").cast("long"), parts))
    (
        placed.hint("rebalance", F.col(name)).sortWithinPartitions(name, "id")
        .write.mode(mode).partitionBy(name).parquet(path)
    )


def fetch(docs: DataFrame, top: DataFrame) -> DataFrame:
    """The documents of ``top`` (id, rank), in its order.

    The ids of up to ``FEW`` hits are taken in as values. They reach the scan: of documents
    stored by ``write_documents`` only their parts are read, and of a part only the row groups
    that can hold them. More hits meet the documents in a join.
    """
    spark, columns = docs.sparkSession, _plain(docs)
    hits = top.limit(FEW + 1).collect()
    if len(hits) <= FEW:
        ids = [r["id"] for r in hits]
        docs = docs.where(F.col("id").isin(ids))
        for name in (c for c in docs.columns if c.startswith(PART)):
            parts = _part(F.col("id").cast("long"), int(name[len(PART):]))
            numbers = spark.createDataFrame([(i,) for i in ids], "id long").select(parts).distinct().collect()
            docs = docs.where(F.col(name).isin([r[0] for r in numbers]))
        top = spark.createDataFrame(hits, top.schema)
    return docs.join(top, "id").select(*columns, "rank").orderBy("rank", "id")


def build_postings(docs: DataFrame, text: str = "summary") -> DataFrame:
    """The word index: (term, doc_id, tf, doc_len).

    All words of a document are counted where it is read, so what is shuffled
    is one row per document and word; nothing, if the documents come dealt by id.
    """
    words = settle(
        docs.select(F.col("id").alias("doc_id"), text),
        _words=tokens(F.coalesce(F.col(text), F.lit(""))),
    )
    return (
        words.select("doc_id", F.size("_words").alias("doc_len"), F.explode("_words").alias("term"))
        .groupBy("term", "doc_id", "doc_len")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select("term", "doc_id", "tf", "doc_len")
    )


def write_postings(postings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store the index sorted by term, so that a lookup reads few row groups.
    Ranges are over (term, document): a word in every document spreads out."""
    order = ["term", "doc_id"]
    # Ranges take a look at all rows first: postings are not to be made twice for that.
    # Sorted rows are half as large on their way.
    made = write_and_reread(postings.sortWithinPartitions(*order))
    made.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)
    discard(made)


def apply_changes(postings: DataFrame, changes: DataFrame, text: str = "summary") -> DataFrame:
    """The index after a batch of changes ``(id, action, <text>)``, where
    action is insert, update or delete and each id occurs once."""
    touched = changes.select(F.col("id").alias("doc_id"))
    fresh = build_postings(changes.filter(F.col("action") != "delete"), text)
    return postings.join(touched, "doc_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def search_postings(
    postings: DataFrame,
    docs: DataFrame,
    stats: DataFrame,
    terms: Sequence[str],
    limit: int = S.SEARCH_LIMIT,
) -> DataFrame:
    """``search`` over the index. Reads the postings of the query's terms only,
    once: what they say of each document is stored, as counts, and then ranked.

    ``stats`` is ``corpus_stats`` of the documents (one row).
    """
    units = _units(terms)
    if not units:
        return _nothing(docs)
    matches = [_matcher(*unit)(F.col("term")) for unit in units]
    wanted = matches[0]
    for match in matches[1:]:
        wanted = wanted | match
    # Word counts per document and unit; a prefix counts all its words.
    per_doc = write_and_reread(
        postings.filter(wanted)
        .groupBy("doc_id", "doc_len")
        .agg(*(
            F.sum(F.when(match, F.col("tf")).otherwise(0)).alias(f"_f{i}")
            for i, match in enumerate(matches)
        ))
    )
    containing = per_doc.agg(F.struct(*(
        F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(units))
    )).alias("containing")).scalar()
    corpus = stats.select(F.struct("n_docs", "avg_len")).scalar()
    hits = per_doc
    for i in range(len(units)):
        hits = hits.filter(F.col(f"_f{i}") > 0)
    score = sum(
        (
            _bm25(F.col(f"_f{i}"), F.col("_in")[f"n{i}"], F.col("_corpus")["n_docs"],
                  F.col("doc_len"), F.col("_corpus")["avg_len"])
            for i in range(len(units))
        ),
        F.lit(0.0),
    )
    top = (
        hits.withColumns({"_in": containing, "_corpus": corpus})
        .select(F.col("doc_id").alias("id"), (-score).alias("rank"))
        .orderBy("rank", "id")
        .limit(limit)
    )
    return fetch(docs, top)

