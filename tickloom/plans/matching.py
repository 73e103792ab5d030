"""The ratio of matching blocks of any two texts, as SQL."""


def _runs(cells: str) -> str:
    """Cells that follow one another on a diagonal, as one row."""
    return f"""(
 SELECT a, b, d, min(i) AS i, max(i) + 1 AS until FROM (
  SELECT *, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS run FROM {cells})
 GROUP BY a, b, d, run)"""


#: ``ratios (a, b, ratio)`` of the pairs in ``asked (a, b)``, all different texts that are not
#: empty: ``SequenceMatcher(None, a, b).ratio()``. Positions i of ``a`` and i - d of ``b`` have the
#: same letter. Of a part of both texts the longest run is a block, of equal ones the first in
#: ``a``, then in ``b``; what lies before it and after it are parts again. If ``b`` has 200 letters
#: or more, its frequent ones begin no block, and only lengthen one.
RATIOS = f"""
cells AS MATERIALIZED (
 SELECT a, b, i - j AS d, i, length(b) >= 200
  AND length(b) - length(replace(b, a[i + 1], '')) > length(b) // 100 + 1 AS frequent
 FROM (SELECT a, b, unnest(range(length(a))) AS i FROM asked)
 JOIN (SELECT a, b, unnest(range(length(b))) AS j FROM asked) USING (a, b) WHERE a[i + 1] = b[j + 1]),
runs AS MATERIALIZED {_runs("cells")},
seeds AS MATERIALIZED {_runs("cells WHERE NOT frequent")},
pieces AS (
 SELECT a, b, 0 AS a0, length(a) AS a1, 0 AS b0, length(b) AS b1, 0 AS n FROM asked
 UNION ALL
 SELECT a, b, if(before, a0, until), if(before, i, a1), if(before, b0, until - d), if(before, i - d, b1),
  if(before, until - i, 0)
 FROM (
  SELECT f.* EXCLUDE (first), r.d, greatest(r.i, a0, b0 + r.d) AS i, least(r.until, a1, b1 + r.d) AS until
  FROM (
   SELECT p.a, p.b, a0, a1, b0, b1, coalesce(
    max({{'n': least(s.until, a1, b1 + s.d) - greatest(s.i, a0, b0 + s.d),
     'i': -greatest(s.i, a0, b0 + s.d), 'j': s.d - greatest(s.i, a0, b0 + s.d)}}) FILTER (WHERE s.i IS NOT NULL),
    {{'n': 0, 'i': -a0, 'j': -b0}}) AS first
   FROM pieces p LEFT JOIN seeds s ON s.a = p.a AND s.b = p.b
    AND least(s.until, a1, b1 + s.d) > greatest(s.i, a0, b0 + s.d)
   GROUP BY p.a, p.b, a0, a1, b0, b1) f
  JOIN runs r ON r.a = f.a AND r.b = f.b AND r.d = first.j - first.i AND -first.i BETWEEN r.i AND r.until - 1
  WHERE least(r.until, a1, b1 + r.d) > greatest(r.i, a0, b0 + r.d)), (VALUES (true), (false)) sides(before)),
ratios AS (SELECT a, b, 2.0 * sum(n) / (length(a) + length(b)) AS ratio FROM pieces GROUP BY a, b)"""


def unlike_sql(source: str, keys: list[str], snapshot_days: int) -> str:
    """``unlike (id, kid)``: rule six for all rows of a sequence that rules one to five leave open
    if ``kid`` is the last kept one."""
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM r.{k}" for k in [*keys, "app", "title"])
    return f"""
open_pairs AS MATERIALIZED (
 SELECT s.id, r.id AS kid, left(coalesce(s.text, ''), 2000) AS a, left(coalesce(r.text, ''), 2000) AS b
 FROM {source} s JOIN {source} r ON {on} AND (r.ts, r.id) < (s.ts, s.id)
  AND s.ts - r.ts < INTERVAL {snapshot_days} DAY
  AND (coalesce(s.url, '') = '' OR s.url IS NOT DISTINCT FROM r.url)),
asked AS MATERIALIZED (SELECT DISTINCT a, b FROM open_pairs WHERE a <> b AND a <> '' AND b <> ''),
{RATIOS.strip()},
unlike AS MATERIALIZED (
 SELECT id, kid FROM open_pairs LEFT JOIN ratios USING (a, b) WHERE a <> b AND coalesce(ratio, 0) < 0.85),
"""
