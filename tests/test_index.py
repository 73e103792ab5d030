"""The stored index after any changes equals an index of the documents as they stand."""

import random

import pytest

from tickloom.operators import index as I, search as Q

WORDS = "heron beans sluice über birds harbour terns oars café".split()
CHANGE = "id long, action string, summary string, seq long"


def batches(seed, n=9, ids=40):
    rng = random.Random(seed)
    out, seq = [], 0
    for b in range(n):
        rows = []
        for _ in range(rng.choice([0, 1, 3, 30])):
            seq += 1
            action = rng.choice(["insert", "update", "update", "delete"])
            text = None if action == "delete" else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))
            rows.append((rng.randrange(ids), action, text, seq))
        rng.shuffle(rows)
        out.append(rows)
    return out


def state(*parts):
    docs = {}
    for rows in parts:
        for i, action, text, _ in sorted(rows, key=lambda r: r[3]):
            docs.pop(i, None) if action == "delete" else docs.__setitem__(i, text)
    return docs


def same(spark, path, docs):
    df = spark.createDataFrame(list(docs.items()), "id long, summary string")
    assert sorted(map(tuple, I.live_postings(spark, path).collect())) == sorted(
        map(tuple, Q.build_postings(df).collect()))
    stats = I.live_stats(spark, path).first()
    want = Q.corpus_stats(df).first()
    assert stats["n_docs"] == want["n_docs"] and (stats["avg_len"] or 0) == pytest.approx(want["avg_len"] or 0)
    found = [tuple(r) for r in I.search_index(spark, path, df, ["birds", "h*"]).collect()]
    assert found == [tuple(r) for r in Q.search(df, ["birds", "h*"]).collect()]


def test_batches_in_turn(spark, tmp_path):
    path = str(tmp_path / "i")
    assert I.segments(spark, path) == [] and I.live_postings(spark, path).count() == 0
    parts = batches(1)
    for b, rows in enumerate(parts):
        df = spark.createDataFrame(rows, CHANGE)
        I.write_changes(df, path, b, "seq")
        if b % 3 == 1:
            I.write_changes(df, path, b, "seq")  # as after a crash before the commit
        if b in (2, 5, 8):
            same(spark, path, state(*parts[:b + 1]))
    assert len(I.segments(spark, path)) < len(parts)
    while I.merge_small(spark, path, growth=1e9):
        same(spark, path, state(*parts))
    assert len(I.segments(spark, path)) == 1


def test_merge_that_ended_early(spark, tmp_path, monkeypatch):
    """Old segments that were not deleted are hidden; a segment without its documents is no part."""
    path = str(tmp_path / "i")
    parts = batches(4, 4, 12)
    drop = I._drop
    monkeypatch.setattr(I, "_drop", lambda spark, path, s: drop(spark, path, s) if s not in I.segments(spark, path) else None)
    for b, rows in enumerate(parts):
        I.write_changes(spark.createDataFrame(rows, CHANGE), path, b, "seq")
    same(spark, path, state(*parts))
    half = spark.createDataFrame([("zzz", 1, 1, 1)], "term string, doc_id long, tf long, doc_len int")
    half.write.parquet(f"{path}/postings/segment={99 * I.BATCH}")
    same(spark, path, state(*parts))


def test_stream_of_changes(spark, tmp_path):
    parts = [p for p in batches(7, 8) if p]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = (spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "in")))
    path = str(tmp_path / "i")
    base = [(i, "insert", "old birds here", 0) for i in range(60)]
    I.write_changes(spark.createDataFrame(base, CHANGE), path, -1)
    I.follow_changes(stream, path, str(tmp_path / "c"), "seq", seconds=None).awaitTermination()
    same(spark, path, state(base, *parts))


def test_small_change_reads_no_old_postings(spark, tmp_path):
    """A batch is written without any look at the postings before it, and lookups prune by term."""
    path = str(tmp_path / "i")
    docs = [(i, "insert", f"w{i} common", 0) for i in range(500)]
    I.write_changes(spark.createDataFrame(docs, CHANGE), path, 0)
    old = f"{path}/postings/segment={I.BATCH}"
    import os
    import shutil
    shutil.move(old, str(tmp_path / "away"))  # reading it would fail
    I.write_changes(spark.createDataFrame([(3, "update", "changed", 1)], CHANGE), path, 1)
    assert len(I.segments(spark, path)) == 2
    shutil.move(str(tmp_path / "away"), old)
    assert os.path.isdir(old)
    found = I.live_postings(spark, path).where("term = 'changed'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,changed)" in plan and found.first()["doc_id"] == 3
    assert I.live_postings(spark, path).where("term = 'w3'").count() == 0
