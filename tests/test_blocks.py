"""Search over blocks gives the same ranks from fewer postings; hits are read from few files."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks as K, search as Q

WORDS = "the heron beans sluice über birds harbour terns oars café".split()


def corpus(spark, n=3000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS[:6] if rng.random() < 0.9 else WORDS) for _ in range(rng.randrange(20, 40))]
        if rng.random() < 0.01:
            words += ["heron"] * 12
        rows.append((i * 3, " ".join(words)))
    return spark.createDataFrame([*rows, (100_001, None), (100_003, "")], "id long, summary string").repartition(4)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs, path = corpus(spark), str(tmp_path_factory.mktemp("search"))
    K.write_blocks(K.build_blocks(Q.build_postings(docs), span=32), f"{path}/blocks")
    Q.write_documents(docs, f"{path}/docs")
    return docs, spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/docs"), Q.corpus_stats(docs)


@pytest.mark.parametrize("terms", [["heron"], ["the"], ["Heron", "beans"], ["cafe", "oars"], ["heron birds", "the"],
                                   ["volcano"], ["volcano", "the"], [" "]])
@pytest.mark.parametrize("limit", [1, 10])
def test_ranks_are_those_of_the_scan(stored, terms, limit):
    docs, blocks, kept, stats = stored
    want = [(r.id, round(r["rank"], 9)) for r in Q.search(docs, terms, limit).collect()]
    found = K.search_blocks(blocks, kept, stats, terms, limit)
    assert [(r.id, round(r["rank"], 9)) for r in found.collect()] == want
    assert found.columns == ["id", "summary", "rank"]


def test_fewer_postings_are_read(stored):
    docs, blocks, kept, stats = stored
    query = K._asked(blocks, stats, ["heron"])
    least = -Q.search(docs, ["heron"], 10).collect()[-1]["rank"]
    wanted = K.wanted_blocks(blocks, query, least)
    all_, some = (d.agg(F.sum("n")).first()[0] for d in (blocks.where("term = 'heron'"), wanted))
    assert some < 0.5 * all_
    assert "GreaterThanOrEqual(weight" in wanted._jdf.queryExecution().executedPlan().toString()
    # Longer documents came since: the bounds still hold.
    longer = stats.select("n_docs", (F.col("avg_len") * 3).alias("avg_len"))
    plain = Q.search_postings(Q.build_postings(docs), docs, longer, ["heron", "beans"], 10)
    got = K.search_blocks(blocks, kept, longer, ["heron", "beans"], 10)
    assert [r.id for r in got.collect()] == [r.id for r in plain.collect()]


def test_prefixes_are_refused(stored):
    with pytest.raises(ValueError):
        K.search_blocks(*stored[1:], ["her*"])


def test_hits_come_from_few_files(spark, stored):
    docs, _, kept, stats = stored
    found = Q.search_postings(Q.build_postings(docs), kept, stats, ["heron"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [id_part_of_256" in plan and "PushedFilters: [In(id" in plan
    assert [r.id for r in found.collect()] == [r.id for r in Q.search(docs, ["heron"], 5).collect()]
    files = kept.where(F.col("id").isin([r.id for r in found.collect()])).select(F.input_file_name()).distinct().count()
    assert files <= 5 < len(kept.inputFiles()) / 10


def test_many_hits_are_joined(stored, monkeypatch):
    docs, _, kept, stats = stored
    want = [r.id for r in Q.search(docs, ["heron"], 40).collect()]
    monkeypatch.setattr(Q, "FEW", 7)
    assert [r.id for r in Q.search(kept, ["heron"], 40).collect()] == want and len(want) == 40


def test_postings_and_blocks_need_one_shuffle_each(spark, tmp_path):
    """Documents dealt by id are counted without another shuffle; blocks are made in the ranges they are stored in."""
    docs = corpus(spark, 200)
    postings = Q.build_postings(docs.repartition("id"))
    assert shuffles(postings) == 1
    assert shuffles(Q.build_postings(docs)) == 2  # one deals the test's rows
    assert sorted(postings.collect()) == sorted(Q.build_postings(docs).collect())
    postings.write.parquet(f"{tmp_path}/postings")
    blocks = K.build_blocks(spark.read.parquet(f"{tmp_path}/postings"), span=32)
    K.write_blocks(blocks, f"{tmp_path}/blocks")
    stored = spark.read.parquet(f"{tmp_path}/blocks")
    assert stored.count() == stored.select("term", "block").distinct().count()
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning(term") == 1 and "hashpartitioning(term" not in plan


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
