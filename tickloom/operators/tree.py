"""Text from trees of interface nodes.

A node row knows its depth, its place in preorder and the ids of its
ancestors, so a walk over a tree becomes filters and joins over rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom import schemas, settings as S
from tickloom.functions import privacy, text as X

NODE_KEY = ["tree_id", "node_id"]


def prune_secure(nodes: DataFrame, secure: Sequence[str] = S.SECURE_SUBROLES) -> DataFrame:
    """Drop secure nodes together with everything below them.

    ``path`` holds a node's ancestors and itself.
    """
    roots = nodes.filter(privacy.is_secure_field(F.col("subrole"), secure)).select(
        "tree_id", F.col("node_id").alias("_up")
    )
    # Most trees have no secure node; only the others look at ancestors.
    below = (
        nodes.select("tree_id", "node_id", "path")
        .join(roots, "tree_id", "left_semi")
        .select("tree_id", "node_id", F.explode("path").alias("_up"))
        .join(roots, ["tree_id", "_up"], "left_semi")
        .select(*NODE_KEY)
        .distinct()
    )
    return nodes.join(below, NODE_KEY, "left_anti").select(*nodes.columns)


def node_texts(nodes: DataFrame) -> DataFrame:
    """One row per non-empty text of a node: value, title, description."""
    attributes = F.array(*(
        F.struct(F.lit(i).alias("part"), X.strip(F.col(c)).alias("text"))
        for i, c in enumerate(["value", "title", "descr"])
    ))
    return (
        nodes.withColumn("_t", F.explode(attributes))
        .select("*", "_t.part", "_t.text")
        .drop("_t")
        .filter(F.col("text") != "")
    )


def tree_texts(
    nodes: DataFrame,
    max_depth: int = S.NATIVE_TREE_DEPTH,
    secure: Sequence[str] = S.SECURE_SUBROLES,
) -> DataFrame:
    """Texts of a tree in reading order, as rows ``(tree_id, preorder, part,
    text)``; nothing from below ``max_depth`` or from secure subtrees."""
    shallow = nodes.filter(F.col("depth") <= max_depth)
    return node_texts(prune_secure(shallow, secure)).select(
        "tree_id", "preorder", "part", "text"
    )


def first_texts(
    texts: DataFrame, max_length: int | None = S.MAX_TEXT_LENGTH
) -> DataFrame:
    """Distinct texts of a tree in reading order, as many as the first
    ``max_length`` characters of the joined text can need.

    One text may still be dropped as the title's copy when they are joined
    (``assemble_text``, which also cuts), so the longest one so far does not
    count. NULL for ``max_length``: all texts.
    """
    distinct = texts.groupBy("tree_id", "text").agg(
        F.min(F.struct("preorder", "part")).alias("_at")
    )
    if max_length is not None:
        before = Window.partitionBy("tree_id").orderBy("_at").rowsBetween(
            Window.unboundedPreceding, -1)
        size = F.length("text") + len(S.TEXT_SEPARATOR)
        start = F.coalesce(F.sum(size).over(before) - F.max(size).over(before), F.lit(0))
        distinct = distinct.withColumn("_start", start).filter(F.col("_start") < max_length)
    return (
        distinct.groupBy("tree_id")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_texts"))
        .select("tree_id", F.transform("_texts", lambda t: t["text"]).alias("texts"))
    )


def best_root(nodes: DataFrame, search_depth: int = S.WEB_SEARCH_DEPTH) -> DataFrame:
    """Per tree the web area with most children and grandchildren, the first
    in reading order where several have as many. Trees without one are absent.
    """
    # A node counts for its parent and for its parent's parent.
    counts = (
        nodes.select("tree_id", F.explode(F.slice(F.reverse("path"), 2, 2)).alias("node_id"))
        .groupBy(*NODE_KEY)
        .agg(F.count(F.lit(1)).alias("score"))
    )
    areas = nodes.filter(
        (F.col("role") == S.WEB_ROLE) & (F.col("depth") <= search_depth)
    ).select("tree_id", "node_id", "depth", "preorder")
    scored = areas.join(counts, NODE_KEY, "left").withColumn(
        "score", F.coalesce("score", F.lit(0))
    )
    best = scored.groupBy("tree_id").agg(
        F.min_by(
            F.struct("node_id", "depth", "score"), F.struct(-F.col("score"), F.col("preorder"))
        ).alias("_best")
    )
    return best.select("tree_id", "_best.*")


def window_texts(
    nodes: DataFrame,
    web_depth: int = S.WEB_CONTENT_DEPTH,
    native_depth: int = S.NATIVE_TREE_DEPTH,
    search_depth: int = S.WEB_SEARCH_DEPTH,
    secure: Sequence[str] = S.SECURE_SUBROLES,
) -> DataFrame:
    """Texts of each window as rows: from its best web area where it has one,
    else from the whole window with the smaller depth."""
    roots = best_root(nodes, search_depth).select(
        "tree_id", F.col("node_id").alias("_root"), F.col("depth").alias("_root_depth")
    )
    placed = nodes.join(roots, "tree_id", "left")
    inside = F.array_contains("path", F.col("_root"))
    wanted = placed.filter(
        F.when(
            F.col("_root").isNotNull(),
            inside & (F.col("depth") - F.col("_root_depth") <= web_depth),
        ).otherwise(F.col("depth") <= native_depth)
    )
    # Only secure nodes at or below the root prune: the walk starts there.
    return node_texts(prune_secure(wanted, secure)).select(
        "tree_id", "preorder", "part", "text"
    )


def window_text(
    nodes: DataFrame, max_length: int | None = S.MAX_TEXT_LENGTH, **options
) -> DataFrame:
    """(tree_id, texts): what the capture projection takes as ``texts``."""
    return first_texts(window_texts(nodes, **options), max_length)


def depth_profile(nodes: DataFrame, max_depth: int = 15, samples: int = 3,
                  sample_length: int = 100) -> DataFrame:
    """Per tree and depth: texts longer than one character, and the first
    few of them. ``depth`` NULL is the line for the whole tree, with the
    deepest level that has text."""
    long = node_texts(nodes.filter(F.col("depth") <= max_depth)).filter(F.length("text") > 1)
    # Each level keeps only its first samples; ranks are cut before grouping.
    order = Window.partitionBy("tree_id", "depth").orderBy("preorder", "part")
    first = (
        long.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= samples)
        .groupBy("tree_id", "depth")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("_rank", F.left("text", F.lit(sample_length)).alias("text")))
            ).alias("_s")
        )
        .select("tree_id", "depth", F.transform("_s", lambda s: s["text"]).alias("samples"))
    )
    levels = long.groupBy("tree_id", "depth").agg(F.count(F.lit(1)).alias("n_texts"))
    totals = levels.groupBy("tree_id").agg(
        F.lit(None).cast("int").alias("depth"),
        F.sum("n_texts").alias("n_texts"),
        F.max("depth").alias("deepest"),
        F.lit(None).cast("array<string>").alias("samples"),
    )
    per_level = levels.join(first, ["tree_id", "depth"]).withColumn(
        "deepest", F.lit(None).cast("int")
    )
    columns = ["tree_id", "depth", "n_texts", "deepest", "samples"]
    return per_level.select(*columns).unionByName(totals.select(*columns))


# How markup maps to interface roles.
HTML_ROLES = {
    "html": "AXWindow", "body": "AXWebArea", "article": "AXWebArea", "iframe": "AXWebArea",
    "a": "AXLink", "button": "AXButton", "input": "AXTextField", "textarea": "AXTextArea",
    "img": "AXImage", "ul": "AXList", "ol": "AXList", "h1": "AXHeading", "h2": "AXHeading",
    "h3": "AXHeading", "p": "AXStaticText", "table": "AXTable",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "source", "track", "wbr"}
_SILENT = {"script", "style"}
# Elements that end where the next of their kind begins.
_ENDED_BY_NEXT = {"li", "p", "tr", "td", "th", "option", "dt", "dd"}


class _NodeReader(HTMLParser):
    """Markup of one page to node rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in _ENDED_BY_NEXT and self.open and self.open[-1][0] == tag:
            self.open.pop()
        above = self.open[-1][1] if self.open else None
        node_id = len(self.nodes) + 1
        secure = tag == "input" and (given.get("type") or "").lower() == "password"
        self.nodes.append({
            "node_id": node_id,
            "parent_id": above,
            "depth": len(self.open),
            "path": [i for _, i in self.open] + [node_id],
            "role": HTML_ROLES.get(tag, "AXGroup"),
            "subrole": "AXSecureTextField" if secure else None,
            "value": [given["value"]] if given.get("value") else [],
            "title": given.get("title"),
            "descr": given.get("alt") or given.get("aria-label"),
        })
        if tag not in _VOID:
            self.open.append((tag, node_id))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] not in _SILENT and data.strip():
            self.nodes[self.open[-1][1] - 1]["value"].append(data.strip())


def _read_pages(batches: Iterator[pa.RecordBatch], id_column: str, html_column: str):
    schema = pa.schema([
        ("tree_id", pa.int64()), ("node_id", pa.int64()), ("parent_id", pa.int64()),
        ("depth", pa.int32()), ("preorder", pa.int64()), ("path", pa.list_(pa.int64())),
        ("role", pa.string()), ("subrole", pa.string()), ("value", pa.string()),
        ("title", pa.string()), ("descr", pa.string()),
    ])
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
        pages = batch.column(batch.schema.get_field_index(html_column)).to_pylist()
        for tree_id, html in zip(ids, pages):
            reader = _NodeReader()
            reader.feed(html or "")
            reader.close()
            for node in reader.nodes:
                node["tree_id"], node["preorder"] = tree_id, node["node_id"]
                node["value"] = " ".join(node["value"]) or None
            if reader.nodes:
                yield pa.RecordBatch.from_pylist(reader.nodes, schema)


def html_nodes(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Node rows of whole pages. One page becomes many rows; pages are read in
    Arrow batches where they are stored."""
    return pages.select(id_column, html_column).mapInArrow(
        lambda it: _read_pages(it, id_column, html_column), schemas.NODE
    )
