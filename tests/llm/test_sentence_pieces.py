"""Without dropout the library's own pieces; with it, lossless round trips."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tickloom.llm import sentence_pieces as sp
from tickloom.llm.texts import pieces

SCHEMA = "doc_id long, text string, ids string, key string"
ODD = ["", " ", "  a  b\n c", "\n\n\t", "é\u0000x", "日本語 text 🙂🙂", "a" * 300, "=" * 90 + " x",
       " lead", "trail ", "naïve\r\nCafé", "the " * 50, "x\ny", "<s> </s> <0x41>", "𝔘" * 5]


@pytest.fixture(scope="module")
def model():
    with open(sp.MODEL, "rb") as file:
        return sp.Model(file.read())


def texts(data):
    return pq.read_table(f"{data}/documents.parquet")["text"].to_pylist() + ODD


def encode(model, values, rate):
    out = []
    for p in pieces(pa.array(values), sp.STRETCH):
        ids, bounds = sp.encode(model, p, np.arange(p.begin, p.end, dtype=np.uint64), rate)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_without_dropout_as_the_library(model, data):
    values = texts(data)
    assert encode(model, values, 0) == model.processor.encode(values)


def test_dropout_varies_and_is_lossless(model, data):
    values = texts(data) + ["▁ a▁b"]
    a, b = encode(model, values, 0.1), encode(model, values, 0.1)
    assert a == b != encode(model, values, 0)
    for v, ids in zip(values, a):
        bytes_, bounds = sp.decode(model, np.array(ids, np.int64), np.array([0, len(ids)]))
        assert bytes_.tobytes().decode() == v
        if "▁" not in v:
            assert model.processor.decode(ids) == v
    cuts = {tuple(x) for x in encode(model, ["worthwhile considerations"] * 50, 0.3)}
    assert len(cuts) > 3
    assert len({tuple(x) for x in encode(model, ["abc"], 1.0)}) == 1


def test_draws_belong_to_occurrences(model, data, monkeypatch):
    """Pieces are as if every occurrence were merged for itself, and vary without bound."""
    values = texts(data)[:60] + ODD
    plain = encode(model, values, 0.1)
    monkeypatch.setattr(sp, "_touched", lambda key, chunk, merges, rate: np.arange(len(chunk)))
    assert encode(model, values, 0.1) == plain
    monkeypatch.undo()
    one = encode(model, ["considerations " * 400], 0.3)[0]
    words, word = set(), []
    for i in one:
        if model.processor.id_to_piece(i).startswith("▁"):
            words.add(tuple(word))
            word = []
        word.append(i)
    assert len(words) > 10


def test_agenda_equals_steps(model):
    rng = random.Random(3)
    for rate in (0.0, 0.2):
        for _ in range(300):
            text = "".join(rng.choice("theranoils") for _ in range(rng.randint(2, 30)))
            row = model.char[[ord(c) for c in text]]
            key = np.uint64(rng.getrandbits(63))
            one = sp.merge_agenda(model, row, key, rate)
            ((_, many),) = sp.merge_together(model, row[None, :].copy(), np.array([key]), rate)
            assert one.tolist() == many[0].tolist()


def test_rows(spark, data):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, "null id", "x", "y"), (3, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sp.checked(df).collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    back = sp.decoded(sp.encoded(df)).collect()
    assert sorted((r[0] or -1, r[1] or "") for r in back) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert sp.encoded(df).where("ids IS NULL").count() == 1
    assert sp.checked(spark.createDataFrame([], SCHEMA)).count() == 0
