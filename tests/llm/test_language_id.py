"""Held-out accuracy, and what has no language."""

import random
import zlib

from tickloom.llm import language_id

SCHEMA = "doc_id long, text string, lang string, lang_pred string"


def corpus():
    rng = random.Random(2)
    syllables = {"en": "the of and ing er th re".split(), "de": "der die ung sch ö ge en".split(),
                 "fr": "le de é eau qui ai oi".split()}
    rows = [(i, None if i % 2 else "123 !? ", "en", "x") for i in range(6)] + [(6, "", None, "x")]
    for i in range(7, 400):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
                 for _ in range(rng.randint(3, 150))]
        rows.append((i, " ".join(words), lang if i % 50 else None, "x"))
    return rows


def test_held_out_rows_are_recognised(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    right = []
    for i, text, lang, _ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if i < 7:
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0, False)
        elif r["held_out"] and lang:
            right.append(r["lang_pred"] == lang)
    assert sum(right) > 0.95 * len(right) and len(right) > 40


def test_no_influence_of_held_out_labels(spark):
    rows = corpus()
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, x) for i, t, lang, x in rows]
    a, b = (sorted(language_id.identify(spark.createDataFrame(r, SCHEMA)).collect()) for r in (rows, other))
    assert a == b


def test_unusual_rows(spark):
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "the", "en", None), (1, "the", None, None), (1, "the", None, None)]
    got = language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["lang_pred"] for r in got} == {"und"} and len(got) == 3


def test_a_rare_language_gets_its_part_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 120)
    monkeypatch.setattr(language_id, "PER_LANG", 1)
    rows = [(i, "some words", f"l{i % 5}", "x") for i in range(10_000)]
    rows += [(10_000 + i, "other words", "rare", "x") for i in range(25)]
    got = [r[0] for r in language_id.sample(spark.createDataFrame(rows, SCHEMA))]
    usable = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(10_000, 10_025))
    assert got.count("rare") == min(usable, 20)
    assert all(got.count(f"l{k}") >= 20 for k in range(5)) and len(got) == 120


def test_as_many_languages_as_there_are(spark):
    """Eighty languages, each with words of its own, are all learned."""
    rows = [(i, " ".join(f"{chr(0x4E00 + 40 * (i % 80) + k % 30)}{chr(0x4E00 + 40 * (i % 80) + (i + k) % 30)}"
                         for k in range(30)), f"l{i % 80}", "x") for i in range(2400)]
    got = language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    held = [(r["lang_pred"], f"l{r['doc_id'] % 80}") for r in got if r["held_out"]]
    assert len({p for p, _ in held}) > 70 and sum(p == w for p, w in held) > 0.9 * len(held)
