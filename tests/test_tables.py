"""Stored tables, events, lookups, search, trees, matching."""

import datetime as dt
import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tickloom.operators import lookup, search as Q, tree, windows as W
from tickloom.operators.dedup import dedup
from tickloom.sources import events as E, tables

T0 = dt.datetime(2026, 4, 5, 10)


def captures(spark, rows):
    return spark.createDataFrame(
        [dict(zip(("ts", "app", "title", "text"), r)) for r in rows],
        "ts timestamp, app string, title string, text string")


def test_write_and_read_captures(spark, tmp_path):
    path = str(tmp_path / "captures")
    rows = [
        (T0, "Arc", "Google", "x" * 20_000), (T0 + dt.timedelta(days=1), "Arc", "日本語 🎉", ""),
        (T0, "Notes", "it's \"quoted\"; DROP TABLE", None), (None, "Arc", "t", ""), (T0, None, "t", ""),
        (T0, "Arc", None, ""),
    ]
    rejected = tables.write_captures(captures(spark, rows), path)
    assert rejected.count() == 3
    assert sorted(p for p in os.listdir(path) if p.startswith("date=")) == ["date=2026-04-05", "date=2026-04-06"]
    back = tables.read_table(spark, path, "captures")
    got = {r.title: r for r in back.collect()}
    assert got["Google"].text == "x" * 20_000 and got["日本語 🎉"].text == ""
    assert got["it's \"quoted\"; DROP TABLE"].text is None
    assert all(r.idle is False and r.transition is False and r.window_id is None for r in got.values())
    again = tables.with_id(tables.fill_captures(captures(spark, rows))).filter("title = 'Google'").first().id
    assert again == got["Google"].id
    stored = spark.read.parquet(path)
    day = lookup.captures_between(stored, T0, T0 + dt.timedelta(hours=1))
    assert day.count() == 2
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()


def test_other_tables(spark, tmp_path):
    sessions = spark.createDataFrame(
        [(1, T0, T0, "Arc"), (2, T0, None, "Arc")], "id long, start_ts timestamp, end_ts timestamp, app string")
    assert tables.write_sessions(sessions, str(tmp_path / "s")).count() == 1
    known = tables.read_table(spark, str(tmp_path / "s"), "sessions")
    summaries = spark.createDataFrame(
        [(1, 1, "a", T0), (2, 1, "b", T0 + dt.timedelta(1)), (3, 9999, "c", T0), (4, 1, None, T0)],
        "id long, session_id long, summary string, created_ts timestamp")
    rejected = tables.write_summaries(summaries, known, str(tmp_path / "m"))
    assert sorted(r.id for r in rejected.collect()) == [3, 4]
    found = lookup.summaries_for(known, tables.read_table(spark, str(tmp_path / "m"), "session_summaries"))
    assert [r.summary for r in found.collect()] == ["a", "b"]
    layout = spark.createDataFrame([(T0, [(1, "Arc", 2, "t", (0, 39, 855, 1068))])],
        "ts timestamp, panes array<struct<window_id long, app string, pid int, title string,"
        " bounds struct<X int, Y int, Width int, Height int>>>")
    tables.write_layout(layout, str(tmp_path / "l"))
    back = tables.read_table(spark, str(tmp_path / "l"), "layout")
    latest = lookup.latest_per(back, ["device_id"], ["ts", "panes"]).first()
    assert latest.panes[0].bounds.Height == 1068
    assert lookup.latest_per(back.limit(0), ["device_id"], ["ts"]).count() == 0


def test_lookups(spark):
    rows = [(i, T0 + dt.timedelta(hours=h), a) for i, h, a in
            [(1, 1, "Arc"), (2, -1, "Arc"), (3, 0, "Obsidian")]]
    df = spark.createDataFrame(rows, "id long, ts timestamp, app string")
    half = dt.timedelta(minutes=30)
    assert [r.id for r in lookup.captures_between(df, T0 - half, T0 + half).collect()] == [3]
    assert [r.id for r in lookup.captures_between(df, T0, T0).collect()] == [3]
    assert [r.id for r in lookup.captures_between(df, T0 - 4 * half, T0 + 4 * half).collect()] == [2, 3, 1]
    assert lookup.captures_by_app(df, "Arc").count() == 2
    assert lookup.captures_by_app(df, "arc").count() == 0
    assert [r.id for r in lookup.most_recent(df, 2).collect()] == [1, 3]
    assert lookup.by_id(df, 9).count() == 0
    s = df.withColumnRenamed("ts", "start_ts")
    assert [r.id for r in lookup.sessions_between(s, T0 - half / 2, T0 + half).collect()] == [3]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "day.jsonl"
    path.write_text(
        '{"ts": "2026-04-04T14:32:05Z", "app": "Chrome", "title": "Höhe", "text": "a"}\n\n'
        '{"ts": "2026-04-04T14:32:08+00:00", "app": "Code", "title": "x"}\nnot json\n', encoding="utf-8")
    df = tables.read_captures_jsonl(spark, str(path)).cache()
    rows = tables.quarantine(df).collect()
    assert [r.app for r in rows] == ["Chrome", "Code", "ERROR"]
    assert rows[2].text == "capture failed: not json" and rows[2].pid == -1
    assert rows[0].ts == dt.datetime(2026, 4, 4, 14, 32, 5)
    records = [json.loads(r.record) for r in tables.to_json_records(df.select("app", "title", "url")).collect()]
    assert records[0] == {"app": "Chrome", "title": "Höhe", "url": None}


def test_events(spark):
    rows = [
        (1, T0, "aw-watcher-window_h", 0.0, '{"app": "Firefox"}'),
        (2, T0 + dt.timedelta(minutes=1), "aw-watcher-window_h", -5.0, '{"a": {"b": [1]}}'),
        (3, T0 + dt.timedelta(seconds=30), "aw-watcher-afk_h", 1e9, None),
        (4, T0 - dt.timedelta(minutes=30), "aw-watcher-afk_h", 0.5, "{}"),
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, bucket string, duration double, data string")
    assert [r.event_id for r in E.read_window_events(df, "h", limit=1).collect()] == [2]
    assert E.read_window_events(df, "missing").count() == 0
    assert [r.event_id for r in E.read_afk_events(df, "h", limit=-1, start=T0).collect()] == [3]
    assert [r.event_id for r in E.recent_activity(df).collect()] == [1, 3, 2]
    now = T0 + dt.timedelta(seconds=40)
    assert [r.event_id for r in E.recent_activity(df, ["h"], now=now).collect()] == [1, 3]
    assert E.to_records(df).filter("data = '{}'").count() == 2
    assert {r.bucket: (r.kind, r.n) for r in E.list_buckets(df).collect()} == {
        "aw-watcher-window_h": ("window", 2), "aw-watcher-afk_h": ("afk", 2)}
    spans = spark.createDataFrame([(T0, "b", dt.timedelta(days=1, seconds=1.5), None)],
                                  "ts timestamp, bucket string, duration interval day to second, data string")
    assert E.to_records(spans).first().duration == 86401.5
    assert E.bucket_name("afk", "h") == "aw-watcher-afk_h"


NOTES = [
    "Repaired the rowing boat and its oars", "Sowed beans; the beans need a trellis",
    "Tea with Zoë near the harbour café", "Listened to a talk on tidal pools and birds",
    "Birds at the harbour: terns, gulls, more terns",
]


@pytest.mark.parametrize("terms,match", [
    (["Beans"], "beans"), (["TERNS"], "terns"), (["rowing", "oars"], "rowing oars"),
    (["volcano", "glacier"], "volcano glacier"), (["tid*"], "tid*"),
    (["harbour"], "harbour"), (["cafe"], "cafe"), (["b*", "harbour"], "b* harbour"), (["CAFÉ"], "cafe"),
    (["rowing oars"], "rowing oars"), ([" birds  harbour "], "birds harbour"), (["zoe\u0308"], "zoe"),
])
def test_search_equals_fts(spark, terms, match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(summary)")
    rng = random.Random(4)
    words = "heron beans sluice über naïve birds harbour terns oars zoe\u0308 cafe\u0301".split()
    texts = NOTES + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    con.executemany("INSERT INTO f(rowid, summary) VALUES (?, ?)", enumerate(texts))
    want = con.execute("SELECT rowid, rank FROM f WHERE f MATCH ? ORDER BY rank, rowid LIMIT 50", (match,)).fetchall()
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, summary string")
    found = {
        "scan": Q.search(docs, terms),
        "index": Q.search_postings(Q.build_postings(docs), docs, Q.corpus_stats(docs), terms),
    }
    for df in found.values():
        got = {r.id: r["rank"] for r in df.collect()}
        assert len(got) == len(want)
        for i, rank in want:
            if i in got:
                assert got[i] == pytest.approx(rank, rel=1e-9)
        assert sorted(got.values()) == pytest.approx(sorted(r for _, r in want), rel=1e-9)


def test_search_without_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, summary string")
    index = Q.build_postings(docs)
    for terms in ([], [""], [" ,; "]):
        assert Q.search(docs, terms).count() == 0
        assert Q.search_postings(index, docs, Q.corpus_stats(docs), terms).count() == 0


def test_accents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "two cafe\u0301s"), (2, "caf\u00e9s"), (3, "cafe s")], "id long, summary string")
    assert {r.id for r in Q.search(docs, ["cafes"]).collect()} == {1, 2}


def test_ids_tell_columns_apart(spark):
    rows = [("x", None), (None, "x"), ("x", "x"), (None, None)]
    df = spark.createDataFrame(rows, "text string, url string").selectExpr("CAST(NULL AS BIGINT) AS id", "*")
    ids = [r.id for r in tables.with_id(df).collect()]
    assert len(set(ids)) == 4
    assert ids == [r.id for r in tables.with_id(df).collect()]


def test_long_trees_fill_the_text(spark):
    """As many texts as the limit takes, even if one of them is the title."""
    from tickloom.functions import text as X

    rows = [(1, i, 0, f"text number {i}") for i in range(9000)] + [(2, 0, 0, "short")]
    df = spark.createDataFrame(rows, "tree_id long, preorder long, part int, text string")
    joined = " | ".join(f"text number {i}" for i in range(9000))
    for title, want in (("", joined), ("text number 3", joined.replace("text number 3 | ", "", 1))):
        got = {r.tree_id: r.t for r in tree.first_texts(df).select(
            "tree_id", X.assemble_text(F.col("texts"), F.lit(title)).alias("t")).collect()}
        assert got == {1: want[:20_000], 2: "short"}
    assert tree.first_texts(df, None).filter("tree_id = 1").select(F.size("texts")).first()[0] == 9000


def test_index_changes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "id long, summary string")
    changes = spark.createDataFrame([(1, "delete", None), (2, "update", "x b b"), (4, "insert", "a")],
                                    "id long, action string, summary string")
    path = str(tmp_path / "p")
    Q.write_postings(Q.build_postings(docs), path)
    after = Q.apply_changes(spark.read.parquet(path), changes)
    want = Q.build_postings(spark.createDataFrame([(2, "x b b"), (3, "c"), (4, "a")], docs.schema))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, want.collect()))


def node(tree_id, node_id, path, role="AXGroup", subrole=None, value=None, title=None, descr=None):
    return dict(tree_id=tree_id, node_id=node_id, parent_id=path[-2] if len(path) > 1 else None,
                depth=len(path) - 1, preorder=node_id, path=path, role=role, subrole=subrole,
                value=value, title=title, descr=descr)


def test_tree(spark):
    from tickloom.schemas import NODE
    nodes = spark.createDataFrame([
        node(1, 1, [1], role="AXWindow", title="Win"),
        node(1, 2, [1, 2], role="AXWebArea", value=" shell "),
        node(1, 3, [1, 3], role="AXWebArea", title="page", descr="d", value="v"),
        node(1, 4, [1, 3, 4], subrole="AXSecureTextField", value="secret"),
        node(1, 5, [1, 3, 4, 5], value="below secret"),
        node(1, 6, [1, 3, 6], value="v", title="  "),
        node(2, 1, [1], title="native"),
        node(2, 2, [1, 2], value="child"),
    ], NODE)
    best = {r.tree_id: (r.node_id, r.score) for r in tree.best_root(nodes).collect()}
    assert best == {1: (3, 3)}
    got = {r.tree_id: r.texts for r in tree.window_text(nodes).collect()}
    assert got == {1: ["v", "page", "d"], 2: ["native", "child"]}
    assert {r.tree_id: r.texts for r in tree.window_text(nodes, native_depth=0).collect()}[2] == ["native"]
    assert tree.prune_secure(nodes).filter("tree_id = 1").count() == 4
    profile = {(r.tree_id, r.depth): (r.n_texts, r.deepest, r.samples) for r in tree.depth_profile(nodes).collect()}
    assert profile[(1, None)] == (5, 3, None) and profile[(1, 1)] == (2, None, ["shell", "page"])


def test_html(spark):
    html = ('<html><body title="top"><p>Hello <b>bold</b></p><input type="password" value="pw">'
            '<img alt="pic"><script>x()</script><ul><li>one<li>two</ul></body></html>')
    nodes = tree.html_nodes(spark.createDataFrame([(7, html), (8, None)], "page_id long, html string"))
    assert {r.tree_id: r.texts for r in tree.window_text(nodes).collect()} == {
        7: ["top", "Hello", "bold", "pic", "one", "two"]}


def best_partner(win, elements):
    """The least (kind, order) over all elements of the window's process."""
    pid, _, title, box = win
    mine = [e for e in elements if e[0] == pid]
    kinds = [(0, lambda e: bool(title) and e[2] == title),
             (1, lambda e: e[3] is not None and max(abs(a - b) for a, b in zip(box, e[3])) <= 5),
             (2, lambda e: len(mine) == 1)]
    return min(((kind, e[1]) for e in mine for kind, fits in kinds if fits(e)), default=(None, None))[1]


def test_match(spark):
    rng = random.Random(8)
    bounds = lambda: tuple(rng.choice([0, 3, 36, 39, 41, 44, 80]) for _ in range(4))
    wins = [(rng.randrange(40), i, rng.choice(["", "a", "b"]), bounds()) for i in range(300)]
    els = [(rng.randrange(60), i, rng.choice(["", "a", "c"]), rng.choice([None, bounds(), bounds()]))
           for i in range(90)]
    kind = "struct<X int, Y int, Width int, Height int>"
    wdf = spark.createDataFrame(wins, f"pid int, window_id long, title string, bounds {kind}")
    edf = spark.createDataFrame(els, f"pid int, ax_order long, title string, bounds {kind}").withColumn(
        "handle", F.concat(F.lit("e"), F.col("ax_order")))
    got = W.match_windows(wdf, edf, ["pid"], payload=["handle"]).collect()
    assert {r.window_id: r.ax_order for r in got} == {w[1]: best_partner(w, els) for w in wins}
    assert all((r.handle is None and r.match_kind is None) if r.ax_order is None else r.handle == f"e{r.ax_order}" for r in got)
    assert len(got) == len(wins)


def test_match_few_and_many(spark):
    """The same matches however many elements are held together; then windows and elements are dealt out once."""
    rng = random.Random(9)
    bounds = lambda: rng.choice([None, tuple(rng.choice([0, 3, 36, 39, 41, 2**31 - 1, None]) for _ in range(4))])
    wins = [(rng.choice([None, *range(30)]), i, rng.choice(["", None, "a", "b"]), bounds()) for i in range(300)]
    els = [(rng.choice([None, *range(45)]), rng.choice([None, i, i]), rng.choice(["", None, "a", "c"]), bounds())
           for i in range(80)]

    def near(a, b):
        return a and b and all(x is not None and y is not None and abs(x - y) <= 5 for x, y in zip(a, b))

    def partner(win):
        mine = [e for e in els if win[0] is not None and e[0] == win[0]]
        kinds = [("title", lambda e: e[2] and e[2] == win[2]), ("bounds", lambda e: near(win[3], e[3])),
                 ("only", lambda e: len(mine) == 1)]
        for kind, fits in kinds:
            found = [e[1] for e in mine if fits(e) and e[1] is not None]
            if found:
                return min(found), kind
        return None, None

    kind = "struct<X int, Y int, Width int, Height int>"
    wdf = spark.createDataFrame(wins, f"pid int, window_id long, title string, bounds {kind}")
    edf = spark.createDataFrame(els, f"pid int, ax_order long, title string, bounds {kind}")
    want = {w[1]: partner(w) for w in wins}
    # The joins by place look one tolerance around a side, which must be in range.
    small = [w for w in wins if not w[3] or all(x is None or x < 2**31 - 1 for x in w[3])]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, some in ((64, wins), (2, small), (1, small)):
            got = W.match_windows(
                wdf.where(F.col("window_id").isin([w[1] for w in some])), edf, ["pid"], few=few)
            assert {r.window_id: (r.ax_order, r.match_kind) for r in got.collect()} == {w[1]: want[w[1]] for w in some}
            assert got.columns == ["pid", "window_id", "title", "bounds", "ax_order", "match_kind"]
        once = W.match_windows(wdf, edf, ["pid"])._jdf.queryExecution().executedPlan().toString()
        assert once.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        W.match_windows(wdf, edf, ["pid"], few=0)


def test_dedup_keeps_input(spark):
    empty = captures(spark, []).selectExpr("1L AS device_id", "1L AS window_id", "1L AS id", "*", "'' AS url")
    assert dedup(empty).count() == 0


def test_shared_folder_is_the_clusters(spark):
    from tickloom.session import shared_folder, write_and_reread

    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    stored = write_and_reread(spark.range(3))
    assert stored.count() == 3 and folder in stored.inputFiles()[0]


def test_discarded_stages_are_deleted(spark):
    from tickloom.session import discard, write_and_reread

    first = write_and_reread(spark.range(3))
    second = write_and_reread(first.where("id > 0"))
    path = first._stage
    discard(first, second.where("id > 1"), spark.range(1))
    assert not os.path.exists(path) and second.count() == 2
