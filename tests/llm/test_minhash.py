"""Near-duplicate groups against all pairs."""

import random
import re

from tickloom.llm import minhash
from tickloom.llm.components import components

SCHEMA = "doc_id long, text string, node string, band long"


def shingles(text, size=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ba", "Ne", "ro", "tö"]) for _ in range(rng.randint(1, 3)))
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "a b c d", "a b c d e"]
    for base in range(6):
        words = [word() for _ in range(rng.choice([30, 60, 200]))]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy[: rng.choice([len(copy), len(copy) - 3])]))
    for _ in range(60):
        texts.append("The and attion to thanedble the " + " ".join(word() for _ in range(9)))
    rng.shuffle(texts)
    return [(i * 7 - 100, t, "x", 1) for i, t in enumerate(texts)]


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r[0]: tuple(r[1:]) for r in minhash.groups(df, size=4).collect()}
    want = brute(rows)
    assert got == want
    kept = {r["doc_id"] for r in minhash.dedup(df, size=4).collect()}
    assert kept == {i for i, w in want.items() if w[2]}


def test_small_cells(spark, monkeypatch):
    """Bands larger than a cell."""
    monkeypatch.setattr(minhash, "CELL", 4)
    rows = corpus()
    got = {r[0]: tuple(r[1:]) for r in minhash.groups(spark.createDataFrame(rows, SCHEMA), size=4).collect()}
    assert got == brute(rows)


def test_unusual_rows(spark):
    text = "a b c d e f g"
    rows = [(None, text, None, None), (3, text, None, None), (3, text, None, None), (5, text, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r[0] or 0), r[2] or 0, r[3]) for r in minhash.groups(df, size=4).collect())
    assert got == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert minhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 60)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(3, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {k: v for k, v in root.items() if k != 3}
