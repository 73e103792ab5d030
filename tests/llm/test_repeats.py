"""Cut passages against brute force over all windows."""

import hashlib
import random
import re

import pytest

from tickloom.llm import repeats, suffix_dedup, window_dedup

SCHEMA = "doc_id long, text string, source string, n_chars long, places string, _places string, copy string"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    syllables = ["ba", "ne", "ro", "tö", "li", "ské"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(40, 120)) for _ in range(5)]
    texts = [None, "", " \n\t ", "ro", "ro " * 400, "é" * 700, prose(3000)]
    while len(texts) < n:
        parts = [rng.choice([prose(rng.randint(1, 90)), rng.choice(shared)]) for _ in range(4)]
        texts.append(rng.choice([" ", "\n", ""]).join(parts))
        if rng.random() < 0.3:
            words = texts[-1].split(" ")
            words[rng.randrange(len(words))] = "other"
            texts.append(" ".join(words))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    rng.shuffle(texts)
    return [(i * 3 - 20, t, "s", 0, "x", "y", "z") for i, t in enumerate(texts)]


def brute_bytes(rows, size=100):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            if (piece := data[p:p + size]) in seen:
                gone[p:p + size] = b"\1" * size
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, size=50):
    least = {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    for i, w in split.items():
        for p in range(len(w) - size + 1):
            key = tuple(w[p:p + size])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if least[tuple(w[p:p + size])] < i:
                gone[p:p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_bytes_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.cuts(df.repartition(5)).collect()}
    assert got == brute_bytes(rows)


def test_words_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in window_dedup.cuts(df.repartition(5)).collect()}
    assert got == brute_words(rows)


@pytest.mark.parametrize("piece", [700])
def test_long_texts_in_slices(spark, rows, monkeypatch, piece):
    """Slices of long texts change nothing."""
    import numpy as np

    steps = suffix_dedup.ladder()
    data = np.frombuffer(("ro tö " * 90 + rows[5][1] if rows[5][1] else "ab" * 3000).encode(), np.uint8)
    codes = suffix_dedup.byte_codes()[data]
    bounds = np.array([0, len(codes)])
    monkeypatch.setattr(repeats, "PIECE", piece)
    found = repeats.all_blocks(steps, codes, bounds)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(found.first, found.count)])
    assert starts.tolist() == list(range(len(codes) - 99))


def test_rewritten_documents(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    cut = {r["doc_id"]: r for r in suffix_dedup.dedup(df).collect()}
    assert len(cut) == len(rows)
    for i, text, *_ in rows:
        assert cut[i]["n_chars"] == len(cut[i]["text"]) and (cut[i]["places"], cut[i]["_places"]) == ("x", "y")
    cut = {r["doc_id"]: r["text"] for r in window_dedup.dedup(df).collect()}
    want = brute_words(rows)
    for i, text, *_ in rows:
        if want[i][1]:
            assert hashlib.sha256(cut[i].encode()).hexdigest() == want[i][2]
        else:
            assert cut[i] == text


def test_unusual_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(i, long, None, None, None, None, None) for i in (None, 1, 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r[0] or 0, r[2]) for r in suffix_dedup.cuts(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(long))]
    got = sorted((r[0] or 0, r[2]) for r in window_dedup.cuts(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 120)]
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.cuts(empty).count() == window_dedup.cuts(empty).count() == 0


def test_rows_that_share_a_doc_id(spark):
    """Every text loses its own repeats, whatever other texts of that id hold."""
    rng = random.Random(1)
    prose = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    a, b, c = prose(80), prose(90), prose(400)
    for rows, want in (
        ([(1, a), (2, b), (2, b + a)], [(a, 0), (b, 0), (b + a, len(a))]),
        ([(1, a), (2, a), (2, c)], [(a, 0), (a, len(a)), (c, 0)]),
        ([(1, a), (2, a), (2, "short text")], [(a, 0), (a, len(a)), ("short text", 0)]),
    ):
        df = spark.createDataFrame([(*r, "s", 0, "x", "y", "z") for r in rows], SCHEMA)
        # A passage may begin with the space or letter that both texts happen to share before it.
        got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.cuts(df).collect())
        assert got == sorted((len(t), n) for t, n in want)
        kept = sorted(r["text"] for r in suffix_dedup.dedup(df).collect())
        assert kept == sorted(t[:len(t) - n] for t, n in want)
        words = sorted((r["n_words"], r["n_removed"]) for r in window_dedup.cuts(df).collect())
        lost = {0: 0, len(a): 80 if len(rows[2][1]) < len(b) or rows[1][1] == a else 79}
        assert words == sorted((len(t.split()), lost[n]) for t, n in want)
