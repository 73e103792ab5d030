"""Targets and takes of the mix, and the texts it gives."""

import re

import numpy as np

from tickloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, shard string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = whole - sum(fixed.values())
        level = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if level[s] > 2 * sizes[s]]
        if not over:
            return fixed | level
        fixed |= {s: 2.0 * sizes[s] for s in over}


def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        source = ["a", "b", "ä", "c", None, "tiny"][min(5, int(rng.integers(0, 30)) // 5)]
        source = "big" if i % 3 == 0 else source
        text = "  ".join(f"{i}w{k}" for k in range(int(rng.integers(0, 200)))) + "\n"
        rows.append((i, text, source, "x", len(text)))
    rows += [(300, None, "a", "x", None), (301, "", "tiny", "x", 0), (None, "p q r", None, "x", 5),
             (5, "again " * 70, "b", "x", 0), (400, "one", "single", "x", 3), (401, "", "none", "x", 0)]
    return rows


def test_takes_meet_the_targets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.takes(df).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = water_fill(sizes)
    source_of = {(r[0], len(words(r[1]))): r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got.itertuples():
        source = source_of[None if np.isnan(r.doc_id) else int(r.doc_id), r.size]
        assert r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert taken == {s: round(t) for s, t in want.items()}
    again = mixing.takes(df.repartition(9)).toPandas()
    key = ["doc_id", "size"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_mixed_texts_hold_the_words_taken(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    took = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.takes(df).collect()}
    out = mixing.mixed(df).collect()
    assert sum(len(words(r["text"])) for r in out) == sum(took.values())
    text_of = {r[0]: r[1] for r in rows if r[0] != 5}
    for r in out:
        if r["doc_id"] in text_of:
            own = words(text_of[r["doc_id"]])
            assert len(words(r["text"])) == took[r["doc_id"], len(own)]
            assert set(words(r["text"])) <= set(own)
            assert r["shard"] == "x" and r["n_chars"] == len(r["text"])


def test_repeated_and_missing_rows(spark):
    rows = [(1, "a b c " * 40, "s", "x", 1)] * 3 + [(2, "d " * 50, "t", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mixing.takes(df).count() == 4
    total = mixing.takes(df).agg({"taken": "sum"}).first()[0]
    assert sum(len(words(r["text"])) for r in mixing.mixed(df).collect()) == total
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.takes(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert mixing.takes(blank).first()["taken"] == 0


def test_permutation(spark):
    for n in (1, 2, 3, 64, 65, 1000):
        full = np.full(n, n)
        key = np.full(n, 99, np.uint64)
        out = mixing.permuted(np.arange(n), full, key)
        assert sorted(out.tolist()) == list(range(n))
        assert mixing.permuted(out, full, key, inverse=True).tolist() == list(range(n))


def test_any_column_names(spark):
    names = ["_parts", "_own", "_doc", "_id", "_copy", "bucket", "number"]
    df = spark.createDataFrame([(1, "a b c " * 40, "s", *names)], ["doc_id", "text", "source", *names])
    out = mixing.mixed(df)
    assert out.columns == df.columns and tuple(out.first())[3:] == tuple(names)
