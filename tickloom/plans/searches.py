"""Word search over summaries."""

import uuid

from pyspark.sql import functions as F

from tickloom.operators import blocks as K, index as I, search as Q
from tickloom.plans.registry import query
from tickloom.plans.views import dealt, in_order, table, view
from tickloom.session import discard, stage_folder, write_and_reread

WORDS = """
words AS MATERIALIZED (
 SELECT id, unnest(regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+')) AS term
 FROM {source})
"""
LENGTHS = """
lens AS (SELECT s.id, coalesce(w.n, 0) AS len FROM summaries s
 LEFT JOIN (SELECT id, count(*) AS n FROM words GROUP BY id) w ON w.id = s.id),
corpus AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM lens)
"""
ALL_WORDS = "WITH " + WORDS.format(text="summary", source="summaries").strip()


def ranked(units: list[str], limit: int = 50) -> str:
    """Ranking as SQL; a unit is a condition on ``term``."""
    counts = ", ".join(f"count(*) FILTER (WHERE {u}) AS f{i}" for i, u in enumerate(units))
    both = " AND ".join(f"f{i} > 0" for i in range(len(units)))
    contain = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(units)))
    score = " + ".join(
        f"(CASE WHEN ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6"
        f" ELSE ln((n_docs - n{i} + 0.5) / (n{i} + 0.5)) END)"
        f" * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))"
        for i in range(len(units))
    )
    return ALL_WORDS + "," + LENGTHS + f""",
counts AS (SELECT id, {counts} FROM words GROUP BY id),
containing AS (SELECT {contain} FROM counts),
hits AS (SELECT c.id, -({score}) AS rank FROM counts c JOIN lens USING (id), corpus, containing
 WHERE {both} ORDER BY 2, 1 LIMIT {limit})
SELECT s.id, s.session_id, s.summary, s.model, s.created_ts, round(h.rank, 6) AS rank
FROM hits h JOIN summaries s USING (id)"""


def shown(df):
    return df.select(
        "id", "session_id", "summary", "model", "created_ts", F.round("rank", 6).alias("rank")
    )


@query("Q1_search_word", "summaries", oracle=ranked(["term = 'elle'"]))
def search_word(spark, sf):
    return shown(Q.search(dealt(view(spark, sf, "summaries")), ["Elle"]))


@query("Q1_search_all_words", "summaries", oracle=ranked(
    ["term = 'que'", "term = 'des'", "term = 'une'"]))
def search_words(spark, sf):
    return shown(Q.search(dealt(view(spark, sf, "summaries")), ["que", "DES", "une"]))


@query("Q1_search_prefix", "summaries", oracle=ranked(["starts_with(term, 'thr')", "term = 'with'"]))
def search_prefix(spark, sf):
    return shown(Q.search(dealt(view(spark, sf, "summaries")), ["thr*", "with"]))


@query("Q1_search_no_hit", "summaries", oracle=ranked(["term = 'cryptocurrency'", "term = 'with'"]))
def search_nothing(spark, sf):
    return shown(Q.search(dealt(view(spark, sf, "summaries")), ["cryptocurrency", "with"]))


@query("J1_search_over_index", "summaries", oracle=ranked(["starts_with(term, 'thr')", "term = 'with'"], 200))
def search_index(spark, sf):
    # The index and the corpus figures are stored first, as they would be.
    docs = dealt(view(spark, sf, "summaries"), "id")
    path = f"{stage_folder(spark)}/index-{uuid.uuid4().hex}"
    Q.write_postings(Q.build_postings(docs), path)
    found = Q.search_postings(
        spark.read.parquet(path), docs, write_and_reread(Q.corpus_stats(docs)), ["thr*", "with"],
        limit=200,
    )
    return shown(found)


def _stored(spark, sf):
    """Documents, blocks of postings and corpus figures, as a service would keep them."""
    docs = view(spark, sf, "summaries")
    path = f"{stage_folder(spark)}/search-{uuid.uuid4().hex}"
    Q.write_documents(docs, f"{path}/docs", parts=16)
    postings = write_and_reread(
        Q.build_postings(dealt(docs, "id")).sortWithinPartitions("term", "doc_id"))
    K.write_blocks(K.build_blocks(postings, span=64), f"{path}/blocks")
    discard(postings)
    # Stored documents are many files, which need no dealing.
    kept = spark.read.parquet(f"{path}/docs")
    return spark.read.parquet(f"{path}/blocks"), kept, write_and_reread(Q.corpus_stats(kept))


@query("T4_top_hits_in_blocks", "summaries", oracle=ranked(["term = 'the'"], 10))
def top_hits_in_blocks(spark, sf):
    return shown(K.search_blocks(*_stored(spark, sf), ["the"], limit=10))


@query("Q1_search_all_words_in_blocks", "summaries", oracle=ranked(
    ["term = 'que'", "term = 'des'", "term = 'une'"]))
def search_words_in_blocks(spark, sf):
    return shown(K.search_blocks(*_stored(spark, sf), ["que", "DES", "une"]))


@query("T4_top_hits", "summaries", oracle=ranked(["term = 'the'"], 10))
def top_hits(spark, sf):
    return shown(Q.search(dealt(view(spark, sf, "summaries")), ["the"], limit=10))


POSTINGS = """
lengths AS (SELECT id, count(*) AS doc_len FROM words GROUP BY id)
SELECT w.term, w.id AS doc_id, count(*) AS tf, any_value(l.doc_len) AS doc_len
FROM words w JOIN lengths l ON l.id = w.id GROUP BY w.term, w.id"""


@query("Q2_postings", "summaries", oracle=ALL_WORDS + "," + POSTINGS)
def postings(spark, sf):
    return Q.build_postings(dealt(view(spark, sf, "summaries")))


@query("A3_corpus_stats", "summaries", oracle=ALL_WORDS + "," + LENGTHS + """
SELECT n_docs, round(avg_len, 6) AS avg_len FROM corpus""")
def corpus(spark, sf):
    stats = Q.corpus_stats(dealt(view(spark, sf, "summaries")))
    return stats.withColumn("avg_len", F.round("avg_len", 6))


@query("A3_document_frequency", "summaries", oracle=ALL_WORDS + """
SELECT term, count(DISTINCT id) AS df FROM words GROUP BY term""")
def frequencies(spark, sf):
    return Q.document_frequency(Q.build_postings(dealt(view(spark, sf, "summaries"), "id")))


@query("K5_index_after_changes", "summaries", oracle="""
WITH state AS (
 SELECT s.id, CASE WHEN l.quality = 0 THEN s.summary || ' revised note' ELSE s.summary END AS summary
 FROM summaries s LEFT JOIN labels l ON l.doc_id = s.id WHERE coalesce(l.toxic, 0) <> 1),
""" + WORDS.format(text="summary", source="state").strip() + "," + POSTINGS)
def changed_index(spark, sf):
    docs = dealt(view(spark, sf, "summaries"))
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    action = F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 0, "update")
    changes = (
        docs.join(labels, "id")
        .select("id", action.alias("action"),
                F.concat("summary", F.lit(" revised note")).alias("summary"))
        .filter(F.col("action").isNotNull())
    )
    return Q.apply_changes(Q.build_postings(docs), changes)


# Documents change in two steps; in the second, each fifth labelled one comes back.
CHANGED = """
WITH state AS (
 SELECT s.id, CASE WHEN l.doc_id % 5 = 0 THEN s.summary || ' once more' WHEN l.quality = 0
  THEN s.summary || ' revised note' ELSE s.summary END AS summary
 FROM summaries s LEFT JOIN labels l ON l.doc_id = s.id WHERE coalesce(l.toxic, 0) <> 1 OR l.doc_id % 5 = 0),
"""


def _changed(spark, sf):
    """A stored index that a stream of changes has kept up to date."""
    docs = dealt(view(spark, sf, "summaries")).select("id", "summary")
    labelled = docs.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "id"), "id")
    action = F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 0, "update")
    first = labelled.select("id", action.alias("action"), F.concat("summary", F.lit(" revised note")).alias("summary"),
                            F.lit(1).alias("step")).where("action IS NOT NULL")
    second = labelled.where("id % 5 = 0").select(
        "id", F.lit("update").alias("action"), F.concat("summary", F.lit(" once more")).alias("summary"),
        F.lit(2).alias("step"))
    path = f"{stage_folder(spark)}/index-{uuid.uuid4().hex}"
    I.write_changes(docs.select("id", F.lit("insert").alias("action"), "summary"), f"{path}/index", -1)
    stream = in_order(spark, first.unionByName(second), "step = 1 AND id % 2 = 0", "step = 1 AND id % 2 = 1", "step = 2")
    I.follow_changes(stream, f"{path}/index", f"{path}/progress", "step", seconds=None).awaitTermination()
    return f"{path}/index"


@query("K5_index_stream", "summaries", oracle=CHANGED + WORDS.format(
    text="summary", source="state").strip() + "," + POSTINGS)
def index_stream(spark, sf):
    return I.live_postings(spark, _changed(spark, sf))


@query("K5_index_stream_stats", "summaries", oracle=CHANGED + WORDS.format(
    text="summary", source="state").strip() + """,
lens AS (SELECT s.id, coalesce(w.n, 0) AS len FROM state s
 LEFT JOIN (SELECT id, count(*) AS n FROM words GROUP BY id) w ON w.id = s.id)
SELECT count(*) AS n_docs, round(avg(len), 6) AS avg_len FROM lens""")
def index_stream_stats(spark, sf):
    return I.live_stats(spark, _changed(spark, sf)).withColumn("avg_len", F.round("avg_len", 6))
