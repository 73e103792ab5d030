"""Held-out accuracy, shrinking, and the site's pull on documents that look alike."""

import random
import zlib

import pytest

from tickloom.llm import site_quality

SCHEMA = "doc_id long, host string, path string, text string, n long, good string"


def corpus():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        host = rng.choice(["good.org", "bad.org", "mixed.org", None, f"small{i % 200}.org"])
        p = {"good.org": 0.95, "bad.org": 0.1}.get(host, 0.6)
        path = f"{host}/{i % 3}"
        if host == "mixed.org":
            p = (0.95, 0.5, 0.1)[i % 3]
        good = int(rng.random() < p)
        words = ["".join(rng.choice("ba ne ro li mun".split()) for _ in range(3)) for _ in range(80)]
        clear = rng.random() < 0.5
        text = ("%% " if clear and not good else " ").join(words)
        rows.append((i, host, path, text if clear else " ".join(words), 1, "x"))
        labels.append((i, good, 0))
    return rows, labels


def test_held_out_and_sites(spark):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in site_quality.scored(df, marks).collect()}
    assert len(got) == len(rows)
    good = {i: g for i, g, _ in labels}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 3]
    assert all(got[i]["held_out"] == (i in held) for i in got)
    assert sum(got[i]["predicted"] == good[i] for i in held) > 0.78 * len(held) and len(held) > 150
    share = {(r[1], r[2]): got[r[0]]["path_share"] for r in rows if r[0] in held}
    assert share["mixed.org", "mixed.org/0"] > 0.75 > 0.4 > share["mixed.org", "mixed.org/2"]
    assert share["good.org", "good.org/1"] > 0.85 and share["bad.org", "bad.org/1"] < 0.3
    small = [v for (h, _), v in share.items() if h and h.startswith("small")]
    assert small and all(0.05 < v < 0.98 for v in small)


def test_counts_equal_plain_python(spark):
    rows, labels = corpus()
    marked = spark.createDataFrame(
        [(r[1], r[2], g) for r, (_, g, _) in zip(rows, labels)], "host string, path string, good int")
    hosts, table, share, of_hosts, of_paths = site_quality.sites(marked)
    assert share == pytest.approx(sum(g for _, g, _ in labels) / len(labels))
    assert 1 <= of_hosts <= 10_000 and 1 <= of_paths <= 10_000
    want = {}
    for r, (_, g, _) in zip(rows, labels):
        n, k = want.get((r[1], r[2]), (0, 0))
        want[r[1], r[2]] = (n + 1, k + g)
    assert {(r["host"], r["path"]): (r["n"], r["good"]) for r in table.collect()} == want
    by_host = {}
    for (host, _), (n, k) in want.items():
        m, j = by_host.get(host, (0, 0))
        by_host[host] = (m + n, j + k)
    assert {r["host"]: (r["host_n"], r["host_good"]) for r in hosts.collect()} == by_host


def test_new_paths_have_their_hosts_share(spark):
    """A path without labels falls back to its host, as plain Python has it."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("ba ne ro li mun".split()) for _ in range(3)) for _ in range(80))
    rows = [(i, "bad.org", f"bad.org/{i % 2}", text(), 1, "x") for i in range(300)]
    rows += [(i, f"h{i % 9}.org", f"h{i % 9}.org/0", text(), 1, "x") for i in range(300, 1300)]
    labels = [(i, int(i >= 300 and i % 10 > 0), 0) for i in range(1300)]
    rows += [(5000, "bad.org", "bad.org/new", text(), 1, "x"), (5001, "new.org", "new.org/1", text(), 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in site_quality.scored(df, marks).collect()}
    assert got[5000]["host_share"] < 0.05 and got[5000]["path_share"] < 0.05 and got[5000]["predicted"] == 0

    learned = [(r[1], r[2], g) for r, (i, g, _) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5 != 3]
    _, _, share, of_hosts, of_paths = site_quality.sites(
        spark.createDataFrame(learned, "host string, path string, good int"))
    assert got[5001]["host_share"] == pytest.approx(share) and got[5001]["path_share"] == pytest.approx(share)
    known = {i: g for i, g, _ in labels if zlib.crc32(str(i).encode()) % 5 != 3}
    for i, host, path, *_ in rows:
        own, one = known.get(i, 0), int(i in known)
        at_host, at_path = [g for h, _, g in learned if h == host], [g for _, p, g in learned if p == path]
        h = (sum(at_host) - own + of_hosts * share) / (len(at_host) - one + of_hosts)
        p = (sum(at_path) - own + of_paths * h) / (len(at_path) - one + of_paths)
        assert got[i]["host_share"] == pytest.approx(h) and got[i]["path_share"] == pytest.approx(p)


def test_unusual_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert site_quality.scored(spark.createDataFrame([], SCHEMA), none).count() == 0
    rows = [(None, None, None, None, 1, "x"), (1, "h", None, "", 1, "x"), (1, "h", None, "", 1, "x")]
    got = site_quality.scored(spark.createDataFrame(rows, SCHEMA), none).collect()
    assert len(got) == 3 and all(r["score"] == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert site_quality.scored(spark.createDataFrame(rows, SCHEMA), one).count() == 3
