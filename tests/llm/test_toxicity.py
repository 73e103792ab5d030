"""Held-out accuracy, misspelled terms, quotation, and the automaton."""

import random
import zlib

import pyarrow as pa

from tickloom.llm import toxicity
from tickloom.llm.lexicon import LevenshteinAutomaton, Lexicon, Term
from tickloom.llm.texts import pieces

SCHEMA = "doc_id long, text string, score string, labels string"
BAD = ["blockhead", "numbskull", "dimwit", "Ürgsam"]


def corpus():
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("ba ne ro tö li ské mun dor".split())
                               for _ in range(rng.randint(1, 3))) for _ in range(n)]
    rows, labels = [(0, None, "x", "x"), (1, "", "x", "x")], [(0, 0, 0), (1, 1, None)]
    for i in range(2, 700):
        text, toxic = words(rng.randint(5, 120)), int(rng.random() < 0.25)
        for _ in range(toxic * rng.randint(1, 4)):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text) + ".", "x", "x"))
        labels.append((i, 1, toxic))
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return (rows, labels, spark.createDataFrame(rows, SCHEMA).repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_rows(spark):
    rows, labels, docs, marks = frames(spark)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, marks).collect()}
    assert len(got) == len(rows)
    toxic = {i: t for i, _, t in labels}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert len(held) > 100 and all(got[i]["predicted"] == toxic[i] for i in held if i > 1)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[0]["predicted"] == got[1]["predicted"] == 0


def test_misspelled_and_quoted_terms(spark):
    rows, _, docs, marks = frames(spark)
    extra = [
        (9001, "bane ro numbskul töli ro blockheead mundor", "", ""),
        (9002, 'ro bane said "bane blockhead ro" and ro "li dimwit li" bane', "", ""),
        (9003, "ro bane said bane blockhead ro and ro li dimwit li bane", "", ""),
        (9004, "bane ro mundor töli ro skéli mundor", "", "")]
    df = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, marks).collect() if r["doc_id"] > 9000}
    assert got[9001] > 0.3 and got[9003] > 0.3
    assert got[9002] < got[9003]
    assert got[9004] < 0.1


def test_unusual_rows(spark):
    no_marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.scored(empty, no_marks).count() == 0
    rows = [(None, "blockhead", None, None), (2, "dimwit", None, None), (2, "dimwit", None, None)]
    got = toxicity.scored(spark.createDataFrame(rows, SCHEMA), no_marks).collect()
    assert len(got) == 3 and all(r["score"] < 0.01 and r["predicted"] == 0 for r in got)


def distance(a, b):
    """Insertions, deletions, changes, and swaps of neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_and_trie():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(3, 8)))
    terms = [Term(w, False, 4.0, 2.0) for w in {word() for _ in range(60)}]
    lexicon = Lexicon(terms + [Term("zz", True, 3.0, 1.0)])
    assert lexicon.find("zzbcd").term == "zz"
    for _ in range(3000):
        w = word()
        exact = any(t.text == w for t in terms)
        near = any(len(t.text) >= 5 and distance(t.text, w) == 1 for t in terms) and len(w) >= 4
        hit = lexicon.find(w)
        assert (hit is not None) == (exact or near)
        if hit:
            assert hit.exact == exact
            piece = next(pieces(pa.array([w])))
            assert lexicon.possible(piece.data, piece.bounds[:1], piece.bounds[1:])[0]
        automaton, v = LevenshteinAutomaton(w), word()
        state = automaton.start()
        for c in v:
            state = automaton.step(state, c)
        assert automaton.accepts(state) == (distance(w, v) <= 1)
        two = LevenshteinAutomaton(w, 2)
        state = two.start()
        for c in v:
            state = two.step(state, c)
        assert two.accepts(state) == (distance(w, v) <= 2)


def chosen(*counts):
    """Terms learned from (term, stem, toxic texts) among 100 toxic and 1000 other ones."""
    return toxicity._choose([{"term": t, "stem": s, "pos": p, "neg": 0} for t, s, p in counts], 100, 1000)


def test_misspelled_words_of_a_stem():
    forms = {"blockhead": 30, "blockheads": 25, "blockheaded": 20}
    stems = {f[:k] for f in forms for k in toxicity.STEM_LENGTHS if k < len(f)}
    terms = chosen(*((f, False, n) for f, n in forms.items()), *((s, True, 75) for s in stems))
    lexicon = Lexicon(terms)
    assert any(t.stem for t in terms) and lexicon.find("blockheadery").exact
    texts = ["blxckhead", "blokhead", "blckhead", "bl0ckhead", "blcokhead", "blockehad", "lbockhead", "blockh3ad",
             "blockheda", "blockheadd", "blocckheads", "BLOKHEADED"]
    for text in texts:
        for whole in (text, f"so a {text}, they", f"a\n{text}"):
            piece = next(pieces(pa.array([whole])))
            x = toxicity.features(piece, lexicon)[0]
            misspelled = x[toxicity.FEATURES.index("misspelled")]
            # Some still begin with a stem.
            assert misspelled > 0 or x[toxicity.FEATURES.index("abuse")] > 0, whole
    for text in ("b10ck", "2024", "bl ckhead", "head", "b2b"):
        assert not toxicity.features(next(pieces(pa.array([text]))), lexicon).any()


def test_quotations():
    lexicon = Lexicon([Term("blockhead", False, 3.0, 1.5)])
    far = "nine or more plain words stand between this place and that one "

    def quoted(text):
        x = dict(zip(toxicity.FEATURES, toxicity.features(next(pieces(pa.array([text]))), lexicon)[0]))
        assert (x["quotation"] > 0) != (x["abuse"] > 0)
        return x["quotation"] > 0

    for text in ('"blockhead" they said', 'they said "you blockhead"', 'they said "you blockhead."',
                 f'"{far}, blockhead" was it', "they said 'you blockhead' to us", "they said ‘you blockhead’",
                 "they said “you blockhead”", "„blockhead“ they said", "« blockhead » was said", "(“blockhead”)",
                 f'5" of rain, and "a blockhead" was {far}', "don't say 'blockhead', they said", "“‘blockhead’ was it”"):
        assert quoted(text), text
    for text in ("you blockhead", '"he" you blockhead "she"', 'they "said" you blockhead', "don't, you blockhead, don't",
                 'you blockhead"', '"you blockhead', "5' and you blockhead of 6'", "the dogs' blockhead and cats' one",
                 "'tis a blockhead\nand the dogs' tails"):
        assert not quoted(text), text
