"""Dropped lines against brute force."""

import random
from collections import defaultdict

from tickloom.llm import line_dedup

SCHEMA = "doc_id long, text string, copy string, `row` string, n_chars long, `a.b` string, gone int"
SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, chars=20, docs=3):
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key_of(line)) >= chars:
                held[key_of(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key_of(x)]) < docs or max(held[key_of(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus():
    rng = random.Random(2)
    common = ["All rights reserved by the owners", "  all RIGHTS reserved by the owners\t", "é" * 19 + "É",
              "é" * 19, "\x0bSubscribe to our letter today!\r", "ÄLL rights reserved by the owners", "", "short"]
    rows = []
    for i in range(200):
        lines = [f"own line {i} {k} of this document" for k in range(rng.randint(0, 6))]
        lines += [x for x in common if rng.random() < 0.3]
        rng.shuffle(lines)
        rows.append([i * 2 - 7, "\n".join(lines)])
    rows += [[1000, None], [1001, ""], [1002, "\n\n"], [None, common[0]], [3, common[0] + "\nanother text of doc 3"],
             [3, common[0] + "\nanother text of doc 3"], [5, "\n".join([common[0]] * 5000 + ["end"])],
             [1003, "in two documents only, twice\n" * 2], [1004, "in two documents only, twice"]]
    return [(i, t, "c", "r", len(t or ""), "x", 1) for i, t in rows]


def order(rows):
    return sorted(rows, key=str)


def test_lines_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in line_dedup.cuts(df).collect()]
    assert order(got) == order(brute(rows))
    got = [tuple(r) for r in line_dedup.cuts(df, 5, 2).collect()]
    assert order(got) == order(brute(rows, 5, 2))


def test_documents_keep_their_columns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = line_dedup.dedup(df)
    assert out.schema.names == df.schema.names
    want = order((i, kept if n else t) for (i, _, n, kept), (_, t, *_) in zip(brute(rows), rows))
    assert order((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert all(r["n_chars"] == len(r["text"] or "") and r["a.b"] == "x" and r["row"] == "r" for r in out.collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.cuts(empty).count() == line_dedup.dedup(empty).count() == 0
