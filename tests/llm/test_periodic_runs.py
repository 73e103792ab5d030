"""Runs against brute force over all periods, and texts cut to the first period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, runs string, kept string, n_chars long, n_words string"


def brute(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in found.items())


def collapse(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng, most=90):
    letters, out = rng.choice([1, 2, 2, 3, 4]), []
    while len(out) < rng.randint(0, most):
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
        out += unit * rng.choice([1, 1, 2, 4, 6])
    return out


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (5, 3), (12, 2), (1, 4)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(200):
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        codes = np.array([c for w in texts for c in w], np.uint64)
        bounds = np.cumsum([0, *(len(w) for w in texts)])
        found = P.find_runs(codes, bounds, least, exponent)
        got = [sorted((int(s), int(n), int(q)) for t, s, n, q in zip(*found) if t == i) for i in range(len(texts))]
        assert got == [brute(w, least, exponent) for w in texts]


def test_small_exponents_are_refused():
    with pytest.raises(ValueError):
        P.find_runs(np.zeros(3, np.uint64), np.array([0, 3]), 2, 1)


def corpus():
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join("ähb xy cö d".split(" ")[w] for w in some_words(rng)))
            for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\x0b "), (503, "one"), (504, "ha " * 60_000), (None, "no id " * 9),
             (3, "again and " * 5), (3, "again and " * 5), (505, "Ha ha " * 4 + "nb sp " * 7)]
    return [(i, t, "r", "k", None if t is None else len(t), "n") for i, t in rows]


def split(text):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").replace("  ", " ").split(" ")


def words_of(text):
    return [w for w in split(text) if w]


def test_runs_of_documents(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"])
                  for r in P.runs(df).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        words = words_of(text)
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append((i, len(words), runs, collapse(words, runs)))
    assert got == sorted(want, key=str)


def test_collapsed_documents_keep_their_columns(spark):
    rows = corpus()
    out = P.collapsed(spark.createDataFrame(rows, SCHEMA))
    assert out.schema.names == [c.split()[0] for c in SCHEMA.split(", ")]
    want = []
    for i, text, *_ in rows:
        words = words_of(text)
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append((i, collapse(words, runs) if runs else text))
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert {r["runs"] for r in got} == {"r"}


def test_digest_and_tails(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(str(rng.randrange(400)) for _ in range(rng.randint(0, 200))), "", "", 0, "") for i in range(300)]
    rows.append((None, "a b", "", "", 0, ""))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in P.digest(P.runs(P.with_periodic_tails(df))).collect()}
    changed = 0
    for i, text, *_ in rows:
        words = words_of(text)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        runs = brute(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert changed > 10


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.digest(P.runs(P.with_periodic_tails(empty))).count() == P.collapsed(empty).count() == 0
