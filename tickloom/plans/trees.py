"""Text from interface trees: heap trees of parts, and real pages."""

from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.operators import tree as T
from tickloom.plans.registry import query
from tickloom.plans.views import dealt, table, view
from tickloom.session import write_and_reread

# Secure nodes and all below them; ancestors of heap node n are n >> 1, n >> 2, ...
PRUNED = """
WITH secure AS (SELECT tree_id, node_id, depth FROM nodes WHERE subrole = 'AXSecureTextField' {bound}),
pruned AS (
 SELECT * FROM nodes n WHERE true {bound} AND NOT EXISTS (
  SELECT 1 FROM secure s WHERE s.tree_id = n.tree_id AND s.depth <= n.depth
  AND (n.node_id >> (n.depth - s.depth)) = s.node_id)),
"""
TEXTS = """
texts AS (
 SELECT tree_id, depth, preorder, part, trim(t) AS text FROM (
  SELECT tree_id, depth, preorder, 0 AS part, value AS t FROM {source}
  UNION ALL SELECT tree_id, depth, preorder, 1, title FROM {source}
  UNION ALL SELECT tree_id, depth, preorder, 2, descr FROM {source})
 WHERE trim(t) <> '')
"""


@query("F8_prune_secure", "nodes", oracle=PRUNED.format(bound="").rstrip().rstrip(",") + """
SELECT tree_id, node_id, subrole FROM pruned""")
def pruned(spark, sf):
    return T.prune_secure(view(spark, sf, "nodes")).select("tree_id", "node_id", "subrole")


@query("X1_tree_texts", "nodes", oracle=PRUNED.format(bound="AND depth <= 4")
       + TEXTS.format(source="pruned") + "SELECT tree_id, preorder, part, text FROM texts")
def texts(spark, sf):
    return T.tree_texts(view(spark, sf, "nodes"), max_depth=4)


@query("X1_assembled_text", "nodes", oracle=PRUNED.format(bound="AND depth <= 4")
       + TEXTS.format(source="pruned") + """,
firsts AS (SELECT tree_id, text, min(preorder * 10 + part) AS pos FROM texts GROUP BY tree_id, text)
SELECT tree_id, string_agg(text, ' | ' ORDER BY pos) AS text FROM firsts GROUP BY tree_id""")
def assembled(spark, sf):
    found = T.first_texts(T.tree_texts(view(spark, sf, "nodes"), max_depth=4))
    return found.select("tree_id", F.array_join("texts", " | ").alias("text"))


AREAS = """
scored AS (
 SELECT n.tree_id, n.node_id, n.depth, n.preorder,
  (SELECT count(*) FROM nodes c WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id)
  + (SELECT count(*) FROM nodes c JOIN nodes g ON g.tree_id = c.tree_id AND g.parent_id = c.node_id
     WHERE c.tree_id = n.tree_id AND c.parent_id = n.node_id) AS score
 FROM nodes n WHERE n.role = 'AXWebArea' AND n.depth <= 10),
best AS (
 SELECT tree_id, node_id, depth, score FROM (
  SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, preorder) AS r FROM scored)
 WHERE r = 1)
"""


@query("A2_best_root", "nodes", oracle="WITH " + AREAS.strip() + """
SELECT tree_id, node_id, depth, score FROM best""")
def best_root(spark, sf):
    return T.best_root(view(spark, sf, "nodes"))


@query("X2_window_texts", "nodes", oracle="WITH " + AREAS.strip() + """,
wanted AS (
 SELECT n.* FROM nodes n LEFT JOIN best b ON b.tree_id = n.tree_id
 WHERE CASE WHEN b.node_id IS NOT NULL
  THEN n.depth BETWEEN b.depth AND b.depth + 3 AND (n.node_id >> (n.depth - b.depth)) = b.node_id
  ELSE n.depth <= 2 END),
pruned AS (
 SELECT * FROM wanted n WHERE NOT EXISTS (
  SELECT 1 FROM wanted s WHERE s.subrole = 'AXSecureTextField' AND s.tree_id = n.tree_id
  AND s.depth <= n.depth AND (n.node_id >> (n.depth - s.depth)) = s.node_id)),
""" + TEXTS.format(source="pruned") + "SELECT tree_id, preorder, part, text FROM texts")
def window_texts(spark, sf):
    return T.window_texts(view(spark, sf, "nodes"), web_depth=3, native_depth=2)


@query("A1_depth_profile", "nodes", oracle="WITH " + TEXTS.format(source="nodes").strip() + """,
long AS (SELECT *, row_number() OVER (PARTITION BY tree_id, depth ORDER BY preorder, part) AS r
 FROM texts WHERE length(text) > 1 AND depth <= 5)
SELECT tree_id, depth, count(*) AS n_texts, CAST(NULL AS INTEGER) AS deepest,
 string_agg(CASE WHEN r <= 3 THEN left(text, 100) END, '|' ORDER BY r) AS samples
FROM long GROUP BY tree_id, depth
UNION ALL
SELECT tree_id, NULL, count(*), max(depth), NULL FROM long GROUP BY tree_id""")
def depth_profile(spark, sf):
    return T.depth_profile(view(spark, sf, "nodes"), max_depth=5).withColumn(
        "samples", F.array_join("samples", "|")
    )


@query("X3_html_nodes")
def html_nodes(spark, sf):
    return T.html_nodes(dealt(table(spark, sf, "pages"))).drop("path")


def page_nodes(spark, sf):
    """Node table of the pages, stored: it is read many times below."""
    return write_and_reread(T.html_nodes(dealt(table(spark, sf, "pages"))))


@query("X2_page_text")
def page_text(spark, sf):
    """What would be captured of each page."""
    found = T.window_text(page_nodes(spark, sf))
    return found.select("tree_id", X.assemble_text(F.col("texts"), F.lit("")).alias("text"))


@query("A1_page_depth_profile")
def page_profile(spark, sf):
    return T.depth_profile(page_nodes(spark, sf)).withColumn(
        "samples", F.array_join("samples", "|")
    )
