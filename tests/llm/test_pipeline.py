"""The stages of the pipeline on a small table, each against a plain version."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tests.llm.test_minhash import shingles  # noqa: E402
from tests.llm.test_mixing import water_fill, words  # noqa: E402
from tests.llm.test_quality_rules import plain  # noqa: E402
from tickloom.llm import sentence_pieces  # noqa: E402
from tickloom.session import write_and_reread  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(write_and_reread(stage(spark, frames[-1], data)))
    return frames


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "minhash_near_dedup", "suffix_array_dedup", "mixing_sources", "sentence_pieces"]
    assert all(df.schema.names == stages[0].schema.names for df in stages[:5])
    assert all(df.count() for df in stages)


def test_quality_rules(stages):
    before, after = rows(stages[0]), rows(stages[1])
    failed = {i for i, r in before.items() if plain(r["text"])[-1]}
    assert not failed & set(after) and all(after[i] == before[i] for i in after)
    # Further rejected ones are junk by the look of their characters or words.
    for i in set(before) - failed - set(after):
        text = before[i]["text"]
        marks = sum(text.count(c) for c in "%&*#$|!")
        assert marks > 0.01 * len(text), text[:200]


def test_near_dedup(stages):
    before, after = rows(stages[1]), rows(stages[2])
    sets = {i: shingles(r["text"], 5) for i, r in before.items()}
    root = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert set(after) == {i for i in ids if root[i] == i}


def test_suffix_dedup(stages):
    before, after = rows(stages[2]), rows(stages[3])
    seen = set()
    for i in sorted(before):
        data = before[i]["text"].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if (piece := data[p:p + 100]) in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        assert after[i]["text"] == kept and after[i]["n_chars"] == len(kept)


def test_mixing(stages):
    before, after = rows(stages[3]), rows(stages[4])
    sizes, taken = {}, {}
    for i, r in before.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
        got = words(after[i]["text"]) if i in after else []
        taken[r["source"]] = taken.get(r["source"], 0) + len(got)
        assert set(got) <= set(words(r["text"])) and len(got) <= 2 * len(words(r["text"]))
    assert taken == {s: round(t) for s, t in water_fill(sizes).items()}


def test_pieces(stages):
    mix = {i: r["text"] for i, r in rows(stages[4]).items()}
    assert {r["doc_id"]: r["text"] for r in sentence_pieces.decoded(stages[5]).collect()} == mix


def test_whole_run(spark, data, stages):
    assert sorted(corpus_pipeline.run(spark, data).collect()) == sorted(stages[5].collect())
