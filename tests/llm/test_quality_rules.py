"""Base counts against plain Python; junk goes, prose stays."""

import random
import re

import pyarrow as pa

from tickloom.llm import quality_rules
from tickloom.llm.texts import pieces

SCHEMA = "doc_id long, text string, lang string, kept string"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def corpus():
    rng = random.Random(8)
    syllables = {"en": "the of and ing er th re".split(), "de": "der die ung sch ö ge en".split()}
    rows = [(0, None, "en", "x"), (1, "", "de", "x"), (2, "\n \t\n", None, "x"),
            (3, "é" * 10, "en", "x"), (4, "a b\na b\n a b\na b \n\n", "en", "x"), (5, "x " * 300, "en", "x")]
    for i in range(6, 130):
        lang = rng.choice(["en", "de"])
        parts = syllables[lang]
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 300))]
        text = re.sub(r" (\w+) (\w+) (\w+) (\w+) (\w+) ", r" \1 \2.\n\3 \4, \5 ", " ".join(words))
        rows.append((i, text, lang, "prose"))
    for i in range(130, 136):
        words = ["".join(rng.choice(syllables["en"]) for _ in range(3)) for _ in range(200)]
        rows.append((i, "%%% ".join(words) + "%%%", "en", "junk"))
    return rows


def test_counts_equal_plain_python(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
    for i, text, _, kind in rows:
        assert tuple(got[i][1:7]) == plain(text), (i, text)
        if kind == "prose":
            assert got[i]["kept"] == (not got[i]["base_failed"])
        if kind == "junk":
            assert not got[i]["kept"]
    kept = quality_rules.accepted(df).collect()
    assert {r["doc_id"] for r in kept} == {i for i, r in got.items() if r["kept"]}
    assert all(r["kept"] in ("prose", "x") for r in kept)


def test_unusual_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judged(empty).count() == 0 and quality_rules.accepted(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, None, None), (1, text, None, None), (1, text, None, None), (2, None, "xx", None)]
    got = quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in got) == [
        (0, True), (1, True), (1, True), (2, False)]


def test_a_rare_language_is_not_judged_by_the_others(spark, monkeypatch):
    rng = random.Random(3)
    syllables = "по на ст ра ени ово ть".split()
    rare = [(1000 + i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(60)),
             "ru", "prose") for i in range(2)]
    df = spark.createDataFrame(corpus() + rare, SCHEMA).repartition(3)
    for least in (quality_rules.REFERENCE_WORDS, 100):  # without a reference, and with one
        monkeypatch.setattr(quality_rules, "REFERENCE_WORDS", least)
        got = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
        assert got[1000]["kept"] and got[1001]["kept"]
        assert not any(got[i]["kept"] for i in range(130, 136))


def test_common_words_are_those_of_all_passing_documents(spark):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(names, [1 / (30 + k) for k in range(900)], k=300)), "en", "x") for i in range(300)]
    rows += [(1000 + i, "spam " * 400, "en", "x") for i in range(20)]
    count = {}
    for _, text, *_ in rows[:300]:
        for w in text.split():
            count[w] = count.get(w, 0) + 1
    piece = next(pieces(pa.array([" ".join([*count, "spam"])])))
    code = dict(zip([*count, "spam"], quality_rules._plain(piece)[2].tolist()))
    order = sorted(count, key=lambda w: -count[w])
    sure = {code[w] for w in order if count[w] > count[order[64]]}
    for parts in (1, 7):
        got = quality_rules.references(spark.createDataFrame(rows, SCHEMA).repartition(parts)).common.tolist()
        assert len(got) == 64 and sure <= set(got) and code["spam"] not in got
        assert all(count[w] >= count[order[63]] for w in count if code[w] in set(got))
