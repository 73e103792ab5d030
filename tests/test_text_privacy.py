"""Similarity, URL redaction, privacy predicates, capture projection."""

import datetime as dt
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings as hsettings, strategies as st
from pyspark.sql import functions as F

from tickloom import settings as S
from tickloom.functions import privacy, text as X, times
from tickloom.functions.similarity import ratio, similarity_bound, text_similarity
from tickloom.operators import capture as C

METER = " litres so far | pump 4 | unleaded | pay at the counter"
LEDGER = "Harbour ledger, spring tide, berths three to nine | "


@pytest.mark.parametrize("a,b,check", [
    ("low tide", "low tide", lambda r: r == 1.0),
    ("", "", lambda r: r == 1.0),
    ("tide", "", lambda r: r == 0.0),
    ("", "tide", lambda r: r == 0.0),
    ("eeee", "kkkk", lambda r: r < 0.1),
    ("17.2" + METER, "17.9" + METER, lambda r: r > 0.85),
    ("104.55" + METER, "105.01" + METER, lambda r: r > 0.85),
    (LEDGER + "31 boats | 512 crates", LEDGER + "33 boats | 519 crates", lambda r: r > 0.85),
    ("Gardening weekly: pruning the old pear tree", "Ferry timetable | next boat 18:40", lambda r: r < 0.5),
    ("q" * 2000 + "r" * 300, "q" * 2000 + "s" * 300, lambda r: r == 1.0),
])
def test_similarity(spark, a, b, check):
    assert check(ratio(a, b))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(
        text_similarity(F.col("a"), F.col("b")).alias("s"),
        similarity_bound(F.col("a"), F.col("b")).alias("bound"),
    ).first()
    assert row.s == ratio(a, b) and row.bound >= row.s


def test_similarity_column_equals_matcher(spark):
    texts = ["", None, "abc", "abd", "a" * 300 + "b", "word " * 500, "word " * 400 + "end"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", text_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = (r.a or "")[:2000], (r.b or "")[:2000]
        want = 1.0 if a == b else (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)
        assert r.s == want


# URLs and what is left of them; None: unchanged.
URLS = [
    ("http://quay.test/berth/7?tide=low&token=h9_Q&pier=N", "http://quay.test/berth/7?tide=low&token=[REDACTED]&pier=N"),
    ("https://a/?KEY=z&flag", "https://a/?KEY=[REDACTED]&flag"),
    ("https://a/?a=1?token=9", None),
    ("https://a/#x?token=9", None),
    ("https://a?token=1,", "https://a?token=[REDACTED]"),
    ("https://a/?", None),
    ("https://a/?#", None),
    ("https://a/?x=1#", "https://a/?x=1"),
    ("https://a/b;?token=1", "https://a/b?token=[REDACTED]"),
    ("https://a/b;p?token=1", "https://a/b;p?token=[REDACTED]"),
    ("https://a/b;;?token=1", "https://a/b;;?token=[REDACTED]"),
    ("https://a;?token=1", "https://a;?token=[REDACTED]"),
    ("HTTPS://A/?Token=1", "https://A/?Token=[REDACTED]"),
    ("https://[::1]/?token=1", "https://[::1]/?token=[REDACTED]"),
    ("https://[::1/?token=1", None),
    ("https://a]/?token=1", None),
    ("https://[zz]/?token=1", None),
    ("//h/?token=1", "//h/?token=[REDACTED]"),
    ("/p?token=1&token=2&&x&key", "/p?token=[REDACTED]&token=[REDACTED]&&x&key"),
    ("token=1", None),
    ("?token=1", "?token=[REDACTED]"),
    ("https://a/?token=&auth", "https://a/?token=[REDACTED]&auth"),
    ("https://a/?token==x=y&z", "https://a/?token=[REDACTED]&z"),
    ("https://a/?tokens=1&xtoken=2&api_key=3", "https://a/?tokens=1&xtoken=2&api_key=[REDACTED]"),
    ("https://a/?u=https://b/?token=1", None),
    ("https://a/?x=%74oken&token=é", "https://a/?x=%74oken&token=[REDACTED]"),
    ("mailto:x?token=1", "mailto:x?token=[REDACTED]"),
    ("", None),
    ("https://a/?token=1#token=2&key=3", "https://a/?token=[REDACTED]#token=2&key=3"),
    ("https://a/?a=1&token=1#", "https://a/?a=1&token=[REDACTED]"),
    ("https://u:p@h:8/?card=4&cvv=1", "https://u:p@h:8/?card=[REDACTED]&cvv=[REDACTED]"),
]


def test_scrub_url(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string")
    want = {u: u if clean is None else clean for u, clean in URLS}
    for r in df.select("u", X.scrub_url(F.col("u")).alias("s")).collect():
        assert r.s == want[r.u], r.u
    assert df.select(X.scrub_url(F.col("u"), []).alias("s")).first().s == URLS[0][0]


def test_scrub_generated(spark):
    """Redacting changes values only, and a second time nothing."""
    keys = st.sampled_from(["token", "Token", "page", "key", "ssn", "é", "monkey"])
    values = st.sampled_from(["", "1", "a=b", "%20", "x/y"])
    queries = st.lists(st.tuples(keys, values), min_size=1, max_size=5)
    found = []

    @hsettings(max_examples=200, deadline=None, database=None, derandomize=True)
    @given(queries)
    def collect(pairs):
        secret = ("token", "key", "ssn")
        found.append((
            "https://h.io/p?" + "&".join(f"{k}={v}" for k, v in pairs),
            "https://h.io/p?" + "&".join(
                f"{k}=[REDACTED]" if k.lower() in secret else f"{k}={v}" for k, v in pairs)))

    collect()
    df = spark.createDataFrame(sorted(set(found)), "u string, want string")
    once = df.select("u", "want", X.scrub_url(F.col("u")).alias("s"))
    for r in once.withColumn("again", X.scrub_url(F.col("s"))).collect():
        assert r.s == r.want, r.u
        assert r.again == r.s


# Texts with URLs and what is left of them; None: unchanged.
TEXTS = [
    ("see https://a?token=1, end", "see https://a?token=[REDACTED] end"),
    ("none here", None), ("", None),
    ("https://a/?x=1 https://b/?key=2", "https://a/?x=1 https://b/?key=[REDACTED]"),
    ("a https://c/?auth=1 b", "a https://c/?auth=[REDACTED] b"),
    ("<https://d/?ssn=3>'https://e/?card=1'", "<https://d/?ssn=[REDACTED]>'https://e/?card=[REDACTED]'"),
    ("http://x?y", None),
    ("https://a/?u=https://b/?token=1 ok", None),
    ("https://h;?token=1 x https://a/b;?token=2#", "https://h;?token=[REDACTED] x https://a/b?token=[REDACTED]"),
]


def test_scrub_text(spark):
    df = spark.createDataFrame([(t,) for t, _ in TEXTS] + [(None,)], "t string")
    want = {t: t if clean is None else clean for t, clean in TEXTS} | {None: None}
    for r in df.select("t", X.scrub_text_urls(F.col("t")).alias("s")).collect():
        assert r.s == want[r.t], r.t


def test_private_and_sensitive(spark):
    cases = [
        ("Private Browsing - x", "", True, False), ("my INCOGNITO", "", True, False),
        ("InPrivate", "", True, False), ("Private Window", "", True, False), ("private", "", False, False),
        ("Password  Manager", "", False, True), ("Passwords - x", "", False, True),
        ("Passwords — x", "", False, True), ("password", "", False, False),
        ("Paſſword manager", "", False, True), ("Keychain", "", False, True), ("Credit Card", "", False, True),
        ("", "please Show Password", False, True), ("", "expiry date", False, True),
        ("", "expiration\n date", False, True), ("", "expire date", False, False),
        ("", "CVV", False, True), ("", "rOuting number", False, True), (None, None, False, False),
    ]
    df = spark.createDataFrame(cases, "title string, text string, private boolean, sensitive boolean")
    got = df.select(
        "*", privacy.is_private_window(F.col("title")).alias("p"),
        privacy.is_sensitive_page(F.col("title"), F.col("text")).alias("s"),
    ).collect()
    for r in got:
        assert (r.p, r.s) == (r.private, r.sensitive), r
    odd = [re.compile(p, re.I) for p in S.SENSITIVE_TITLE_PATTERNS]
    for r in got:
        if r.title and not r.text:
            assert r.sensitive == any(p.search(r.title) for p in odd), r
    extra = df.select(privacy.is_sensitive_page(
        F.col("title"), F.col("text"), ["my (bank|vault)"], ["a|incog"]).alias("s"))
    assert extra.first().s is False
    attrs = spark.createDataFrame([("bigIncognitoBrowserWindow",), ("x",), (None,)], "a string")
    assert [r.p for r in attrs.select(privacy.is_private_window(F.lit("t"), F.col("a")).alias("p")).collect()] == [
        True, False, False]


OBS = ("n int, app string, hidden boolean, matched boolean, ax_title string, identifier string,"
       " descr string, subrole string, texts array<string>, page_url string, idle_s double, pid int,"
       " window_id long")


def observed(n, **given):
    row = dict(n=n, app="Arc", hidden=False, matched=True, ax_title="Page", identifier=None, descr=None,
               subrole=None, texts=["some text"], page_url="https://e.org/?token=1&p=2", idle_s=0.04,
               pid=1, window_id=100)
    return {**row, **given}


def test_capture(spark):
    rows = [
        observed(1, app="1Password", hidden=True),
        observed(2, hidden=True),
        observed(3, matched=False, ax_title=None, texts=None, page_url=None),
        observed(4, ax_title="  Incognito "),
        observed(5, texts=["x", "show password"]),
        observed(6, app=""),
        observed(7, page_url="file:///a.asar"),
        observed(8, ax_title="", texts=["y" * 49]),
        observed(9, ax_title="", texts=["y" * 50]),
        observed(10, texts=["Page", "b", "a", "b", "see https://h/?key=1"]),
        observed(11, texts=["z" * 30_000]),
        observed(12, matched=False, ax_title="Incognito"),
        observed(13, app=None, texts=[]),
    ]
    df = spark.createDataFrame(rows, OBS)
    got = {r.n: r for r in C.capture(df, keep=["n"]).collect()}
    assert set(got) == {1, 4, 5, 6, 7, 9, 10, 11, 13}
    assert (got[1].title, got[1].text, got[1].url, got[1].filtered, got[1].window_id) == (
        "[blocked]", "", None, "app_blocked", 100)
    assert (got[4].title, got[4].filtered, got[4].text, got[4].url) == ("[private window]", "private_window", "", None)
    assert (got[5].title, got[5].filtered, got[5].text, got[5].url) == ("[sensitive page]", "sensitive_page", "", None)
    assert got[6].app == "Unknown" and got[13].app == "Unknown" and got[13].text == ""
    assert got[7].url is None and got[6].url == "https://e.org/?token=[REDACTED]&p=2"
    assert got[10].text == "b | a | see https://h/?key=[REDACTED]"
    assert len(got[11].text) == 20_000
    assert got[6].filtered is None and got[6].idle_s == 0.0
    every = C.capture(df, keep=["n"], only_recorded=False)
    assert {r.n for r in every.filter("recorded").collect()} == set(got) and every.count() == 13


def test_times(spark):
    df = spark.createDataFrame([
        ("2026-04-05T10:00:00Z",), ("2026-04-05T10:00:00+00:00",), ("2026-04-05T12:00:00.5+02:00",),
        ("2026-04-05T10:00:00",), ("junk",), (None,)], "t string")
    got = [r.t for r in df.select(times.parse_ts(F.col("t")).alias("t")).collect()]
    base = dt.datetime(2026, 4, 5, 10)
    assert got == [base, base, base + dt.timedelta(seconds=0.5), base, None, None]
    d = df.limit(1).select(times.seconds_between(
        F.lit(base), F.lit(base - dt.timedelta(seconds=1.25))).alias("d")).first().d
    assert d == 1.25


def test_normalise(spark):
    df = spark.createDataFrame([("00:03 / 15:27 talk ⠋ of 1,024 words and 3 comments 12:30",)], "t string")
    assert df.select(X.normalise_text(F.col("t")).alias("t")).first().t == "talk of and"
