"""The ratio of matching blocks as SQL, and the stream that is checked with it."""

import datetime as dt
import random
from difflib import SequenceMatcher

import duckdb

import __spark_entry__ as entry
from tickloom.plans.matching import RATIOS


def test_sql_ratio_is_the_matchers():
    rng = random.Random(4)
    many = "".join(chr(0x4E00 + i) for i in range(150)) + "abcdefghijklmnopqrstuvwxyz"
    pairs = {("abc", "xyz"), ("a", "a" * 200), ("ab" * 110, "ba" * 120)}
    for n in [*range(1, 60), *range(196, 230, 2)]:
        letters = rng.choice(["ab", "abcdefgh é🤦", many])
        a = "".join(rng.choice(letters) for _ in range(n))
        b = list(a)
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(3)] = rng.choice([[rng.choice(letters)], b[max(0, at - 5):at], []])
        if b and "".join(b) != a:
            pairs.add((a, "".join(b)))
    con = duckdb.connect()
    con.execute("CREATE TABLE asked (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO asked VALUES (?, ?)", list(pairs))
    got = {(a, b): r for a, b, r in con.execute(f"WITH RECURSIVE {RATIOS} SELECT * FROM ratios").fetchall()}
    assert got == {(a, b): SequenceMatcher(None, a, b).ratio() for a, b in pairs}
    # Frequent letters of long texts were left out of some.
    assert any(r != SequenceMatcher(None, *p, autojunk=False).ratio() for p, r in got.items())


def test_stream_captures_compares_texts(spark, tmp_path):
    """Captures with one app, title and url, some days apart: only their texts can differ."""
    rng = random.Random(2)
    other = "".join(chr(0x4E00 + i) for i in range(60))
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    shows = {  # type of event, and whether it is kept: types are the end of the text
        1: [("click", True), ("clicks", False), (other, True), (other + "x", False), ("click", True)],
        2: [(long, True), (long[:280], False), (long[:60] + "zy" * 90, True), (long[60:], True)],
        3: [("view", True), ("view", False)],
    }
    rows, kept = [], set()
    for device, its in shows.items():
        for day, (event_type, keeps) in enumerate(its):
            i = 10 * device + day
            rows.append((i, dt.datetime(2024, 1, 1 + day, 9), device, event_type, 1.0, '{"k": 76}'))
            if keeps:
                kept.add((i, event_type))
    spark.createDataFrame(
        rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))

    got = entry.queries()["G1_stream_captures"](spark, str(tmp_path))
    found = [tuple(r) for r in got.collect()]
    assert {(r[0], r[5].rsplit(" | ", 1)[1]) for r in found} == kept and len(found) == len(kept)
    assert len({r[3:5] + r[6:] for r in found}) == 1
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["G1_stream_captures"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(str, want.fetchall())) == sorted(map(str, found))
