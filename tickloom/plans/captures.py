"""Privacy filters, URL redaction and the capture projection."""

from pyspark.sql import functions as F

from tickloom import settings as S
from tickloom.functions import privacy, text as X
from tickloom.operators import capture as C, windows as W
from tickloom.operators.capture import mark_blocked
from tickloom.plans.registry import query
from tickloom.plans.views import dealt, table, view

# Fixed values for the check: the query keys found in the given pages.
PAGE_KEYS = ["ref", "utm_source"]
WS = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# The lists of the settings, as SQL.
BLOCKED = f"lower(app) IN ({sql_list([a.lower() for a in S.BLOCKED_APPS])})"
TITLE_RX = "(?i)" + "|".join(S.SENSITIVE_TITLE_PATTERNS)
TEXT_RX = "(?i)" + "|".join(S.SENSITIVE_CONTENT_PATTERNS)
PRIVATE_RX = "(?i)" + "|".join(S.PRIVATE_TITLE_PATTERNS)
VISIBLE = (f"coalesce(layer, -1) = 0 AND app NOT IN ({sql_list(S.SYSTEM_OWNERS)})"
           f" AND bw >= {S.MIN_WINDOW_SIDE} AND bh >= {S.MIN_WINDOW_SIDE}")


def private_sql(title: str) -> str:
    attributes = " OR ".join(
        f"coalesce({c}, '') ILIKE '%{w}%'"
        for c in ("identifier", "descr", "subrole") for w in S.PRIVATE_ATTRIBUTE_WORDS
    )
    return f"(regexp_matches({title}, '{PRIVATE_RX}') OR {attributes})"


@query("F5_app_on_long_list", "observations", oracle="""
SELECT id, app, lower(app) IN (SELECT lower(c_name) FROM customer) OR lower(app) IN ('bitwarden', 'click') AS blocked
FROM observations""")
def app_on_long_list(spark, sf):
    """A blocklist that is a table."""
    names = table(spark, sf, "customer").select("c_name").unionByName(
        spark.createDataFrame([("Bitwarden",), ("CLICK",), ("click",), (None,)], "c_name string"))
    return mark_blocked(view(spark, sf, "observations"), names, "blocked").select("id", "app", "blocked")


@query("F5_app_blocked", "observations", oracle=f"SELECT id, app, {BLOCKED} AS blocked FROM observations")
def app_blocked(spark, sf):
    return view(spark, sf, "observations").select(
        "id", "app", privacy.is_app_blocked(F.col("app")).alias("blocked")
    )


@query("F6_private_window", "observations", oracle=f"""
SELECT id, {private_sql('ax_title')} AS private FROM observations""")
def private_window(spark, sf):
    return view(spark, sf, "observations").select(
        "id",
        privacy.is_private_window(
            F.col("ax_title"), F.col("identifier"), F.col("descr"), F.col("subrole")
        ).alias("private"),
    )


@query("F7_drop_hidden", "observations", oracle="""
SELECT id, device_id, app FROM observations WHERE NOT coalesce(hidden, false)""")
def hidden(spark, sf):
    return C.drop_hidden(view(spark, sf, "observations")).select("id", "device_id", "app")


@query("F9_sensitive_page", oracle=f"""
SELECT doc_id, regexp_matches(split_part(text, chr(10), 1), '{TITLE_RX}')
 OR regexp_matches(text, '{TEXT_RX}|th[eo] and') AS sensitive FROM documents""")
def sensitive_documents(spark, sf):
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select(
        "doc_id",
        privacy.is_sensitive_page(title, F.col("text"), extra_content=["th[eo] and"]).alias("sensitive"),
    )


@query("F9_sensitive_observation", "observations", oracle=f"""
SELECT id, regexp_matches(ax_title, '{TITLE_RX}')
 OR regexp_matches(array_to_string(texts, ' | '), '{TEXT_RX}') AS sensitive FROM observations""")
def sensitive_observations(spark, sf):
    return view(spark, sf, "observations").select(
        "id",
        privacy.is_sensitive_page(
            F.col("ax_title"), F.array_join("texts", S.TEXT_SEPARATOR)
        ).alias("sensitive"),
    )


@query("F10_visible_windows", "observations", oracle=f"""
SELECT id, device_id, tick_ts, app, window_id FROM observations WHERE {VISIBLE}""")
def visible(spark, sf):
    return W.filter_visible(view(spark, sf, "observations")).select(
        "id", "device_id", "tick_ts", "app", "window_id"
    )


@query("F11_drop_empty", "observations", oracle="""
WITH each AS (SELECT id, ax_title AS title, unnest(texts) AS text FROM observations)
SELECT id, title, text FROM each WHERE NOT (title = '' AND length(text) < 7)""")
def not_empty(spark, sf):
    rows = view(spark, sf, "observations").select(
        "id", F.col("ax_title").alias("title"), F.explode("texts").alias("text")
    )
    return C.drop_empty(rows, 7)


@query("F12_matched_ticks", "observations", oracle=f"""
WITH visible AS (SELECT * FROM observations WHERE {VISIBLE})
SELECT id, device_id, tick_ts, matched FROM visible v
WHERE EXISTS (SELECT 1 FROM visible o WHERE o.device_id = v.device_id AND o.tick_ts = v.tick_ts
 AND o.matched)""")
def matched_ticks(spark, sf):
    seen = W.filter_visible(view(spark, sf, "observations"))
    return W.drop_unmatched_ticks(seen).select("id", "device_id", "tick_ts", "matched")


@query("F13_clean_url", "observations", oracle="""
SELECT id, CASE WHEN page_url LIKE 'file://%' THEN NULL ELSE page_url END AS url FROM observations""")
def cleaned(spark, sf):
    return view(spark, sf, "observations").select("id", X.clean_url(F.col("page_url")).alias("url"))


def scrub_sql(url: str, keys: str) -> str:
    """The redaction of one URL, written as SQL over its parts."""
    front = f"split_part({url}, '#', 1)"
    base = f"split_part({front}, '?', 1)"
    query_part = f"substr({front}, length({base}) + 2)"
    redacted = (
        f"array_to_string(list_transform(string_split({query_part}, '&'), lambda p:"
        f" CASE WHEN contains(p, '=') AND lower(split_part(p, '=', 1)) IN ({keys})"
        f" THEN split_part(p, '=', 1) || '=[REDACTED]' ELSE p END), '&')"
    )
    rest = f"substr({url}, length({front}) + 1)"
    return (
        f"CASE WHEN {query_part} <> '' THEN {base} || '?' || {redacted} ||"
        f" CASE WHEN {rest} = '#' THEN '' ELSE {rest} END ELSE {url} END"
    )


PAGE_KEYS_SQL = "'ref', 'utm_source'"
ALL_KEYS_SQL = ", ".join(f"'{k}'" for k in S.SENSITIVE_URL_KEYS)


@query("P4_scrub_page_url", oracle=f"""
SELECT page_id, {scrub_sql('url', PAGE_KEYS_SQL)} AS url FROM pages""")
def scrubbed_pages(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.scrub_url(F.col("url"), PAGE_KEYS).alias("url")
    )


@query("P4_scrub_observed_url", "observations", oracle=f"""
SELECT id, {scrub_sql('page_url', ALL_KEYS_SQL)} AS url FROM observations""")
def scrubbed_urls(spark, sf):
    return view(spark, sf, "observations").select(
        "id", X.scrub_url(F.col("page_url")).alias("url")
    )


@query("P5_scrub_text_urls", oracle=f"""
WITH mixed AS (
 SELECT 'page' AS kind, page_id AS id,
  html || ' see ' || url || ', "' || url || '" ' || html AS text FROM pages
 UNION ALL SELECT 'document', doc_id, text FROM documents),
cut AS (
 SELECT kind, id, text, regexp_extract_all(text, 'https?://[^{WS}<>"'']+') AS urls FROM mixed),
numbered AS (
 SELECT kind, id, unnest(urls) AS url, generate_subscripts(urls, 1) AS i FROM cut),
pieces AS (
 SELECT kind, id, list(rewritten ORDER BY i) AS rewritten FROM (
  SELECT kind, id, i, {scrub_sql('url', PAGE_KEYS_SQL)} AS rewritten FROM numbered)
 GROUP BY kind, id)
SELECT c.kind, c.id, CASE WHEN p.id IS NULL THEN c.text ELSE list_reduce(list_transform(
  list_zip(regexp_split_to_array(c.text, 'https?://[^{WS}<>"'']+'), p.rewritten),
  lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b) END AS text
FROM cut c LEFT JOIN pieces p ON p.kind = c.kind AND p.id = c.id""")
def scrubbed_texts(spark, sf):
    mixed = F.concat(
        "html", F.lit(" see "), "url", F.lit(', "'), "url", F.lit('" '), "html"
    )
    texts = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), mixed.alias("text")
    ).unionByName(table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    ))
    return texts.withColumn("text", X.scrub_text_urls(F.col("text"), PAGE_KEYS))


@query("P6_assemble_text", "observations", oracle="""
WITH parts AS (
 SELECT id, ax_title, unnest(texts) AS t, generate_subscripts(texts, 1) AS i FROM observations),
firsts AS (SELECT id, t, min(i) AS i FROM parts WHERE t <> ax_title GROUP BY id, t)
SELECT id, left(string_agg(t, ' | ' ORDER BY i), 40) AS text FROM firsts GROUP BY id""")
def assembled(spark, sf):
    return view(spark, sf, "observations").select(
        "id", X.assemble_text(F.col("texts"), F.col("ax_title"), 40).alias("text")
    )


@query("P9_strip", "observations", oracle="""
SELECT id, trim(ax_title) AS title, CASE WHEN app = '' THEN 'x' ELSE app END AS app_wide
FROM observations""")
def stripped(spark, sf):
    app = F.when(F.col("app") == "", "x").otherwise(F.col("app"))
    return view(spark, sf, "observations").select(
        "id",
        X.strip(F.col("ax_title")).alias("title"),
        X.strip(F.concat(F.lit("   "), app, F.lit("\t\n"))).alias("app_wide"),
    )


@query("U2_distinct_in_order", "observations", oracle="""
WITH parts AS (
 SELECT id, unnest(texts) AS t, generate_subscripts(texts, 1) AS i FROM observations)
SELECT id, string_agg(t, '|' ORDER BY i) AS texts FROM (
 SELECT id, t, min(i) AS i FROM parts GROUP BY id, t) GROUP BY id""")
def distinct_in_order(spark, sf):
    return view(spark, sf, "observations").select(
        "id", F.array_join(F.array_distinct("texts"), "|").alias("texts")
    )


CAPTURED = f"""
WITH read AS (
 SELECT *, {BLOCKED} AS blocked,
  CASE WHEN matched THEN trim(ax_title) ELSE '' END AS t FROM observations),
seen AS (
 SELECT *, matched AND {private_sql('t')} AS private,
  matched AND NOT {BLOCKED} AND NOT (matched AND {private_sql('t')}) AS open
 FROM read WHERE blocked OR NOT coalesce(hidden, false)),
parts AS (
 SELECT id, t AS title, unnest(texts) AS x, generate_subscripts(texts, 1) AS i
 FROM seen WHERE open),
joined AS (
 SELECT id, string_agg(x, ' | ' ORDER BY i) AS raw FROM (
  SELECT id, x, min(i) AS i FROM parts WHERE x <> title GROUP BY id, x) GROUP BY id),
-- The only URL in these texts is the one behind 'see '.
scrubbed AS (
 SELECT id, regexp_replace(raw, '(https://h.io/a[?]key)=[0-9]+&', '\\1=[REDACTED]&') AS body
 FROM joined),
judged AS (
 SELECT s.*, CASE WHEN open THEN coalesce(body, '') ELSE '' END AS body,
  CASE WHEN open THEN {scrub_sql("(CASE WHEN page_url LIKE 'file://%' THEN NULL ELSE page_url END)", ALL_KEYS_SQL)} END AS clean
 FROM seen s LEFT JOIN scrubbed USING (id)),
labelled AS (
 SELECT *, CASE WHEN blocked THEN 'app_blocked' WHEN private THEN 'private_window'
  WHEN open AND (regexp_matches(t, '{TITLE_RX}') OR regexp_matches(body, '{TEXT_RX}'))
  THEN 'sensitive_page' END AS filtered FROM judged),
captured AS (
 SELECT id, device_id, tick_ts, z,
  CASE WHEN filtered IS NULL AND app = '' THEN 'Unknown' ELSE app END AS app,
  CASE filtered WHEN 'app_blocked' THEN '[blocked]' WHEN 'private_window' THEN '[private window]'
   WHEN 'sensitive_page' THEN '[sensitive page]' ELSE t END AS title,
  CASE WHEN filtered IS NULL THEN body ELSE '' END AS text,
  CASE WHEN filtered IS NULL THEN clean END AS url,
  pid, window_id, idle_s, filtered
 FROM labelled WHERE filtered IS NOT NULL OR t <> '' OR length(body) >= 50)
"""


@query("P7_capture", "observations", oracle=CAPTURED + """
SELECT id, device_id, tick_ts, app, title, text, url, pid, window_id, idle_s, filtered
FROM captured""")
def captured(spark, sf):
    return C.capture(dealt(view(spark, sf, "observations")), keep=["id", "device_id", "tick_ts"])


@query("J4_match_windows", "cg_windows", "ax_elements", oracle="""
WITH counted AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM ax_elements),
win AS (SELECT *, row_number() OVER () AS wid FROM cg_windows),
pairs AS (
 SELECT w.wid, e.ax_order,
  CASE WHEN w.title <> '' AND w.title = e.title THEN 1
   WHEN abs(w.bx - e.bx) <= 5 AND abs(w.by_ - e.by_) <= 5 AND abs(w.bw - e.bw) <= 5
    AND abs(w.bh - e.bh) <= 5 THEN 2
   WHEN n = 1 THEN 3 END AS prio
 FROM win w JOIN counted e USING (pid)),
best AS (
 SELECT wid, prio, ax_order, row_number() OVER (PARTITION BY wid ORDER BY prio, ax_order) AS r
 FROM pairs WHERE prio IS NOT NULL)
SELECT w.pid, w.window_id, b.ax_order,
 CASE b.prio WHEN 1 THEN 'title' WHEN 2 THEN 'bounds' WHEN 3 THEN 'only' END AS match_kind
FROM win w LEFT JOIN best b ON b.wid = w.wid AND b.r = 1""")
def matched(spark, sf):
    found = W.match_windows(
        view(spark, sf, "cg_windows"), view(spark, sf, "ax_elements"), process=["pid"])
    return found.select("pid", "window_id", "ax_order", "match_kind")
