"""The given tables in the shapes the operators work on.

Each view is a list of SQL expressions that reads the same in Spark and in
other SQL engines, so a check against another engine starts from equal rows.
``{k}``, ``{list}`` and ``{ts}`` stand for the few spellings that differ.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.settle import settle
from tickloom.session import stage_folder

SPARK = {
    "k": "_k",
    "list": "array",
    "ts": "timestamp_seconds",
    "bin": "bin",
}

# name -> (table, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    # One capture per event.
    "captures": ("events", [
        "event_id AS id",
        "user_id AS device_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_type AS app",
        "concat('t', CAST({k} % 3 AS STRING)) AS title",
        "concat('note ', event_type, ' number ', CAST({k} AS STRING)) AS text",
        "CASE WHEN {k} % 3 = 0 THEN NULL ELSE concat('u', CAST({k} % 7 AS STRING)) END AS url",
        "round(value, 1) AS idle_s",
        "CAST(100 + {k} % 4 AS INT) AS pid",
        "CAST({k} % 5 AS BIGINT) AS window_id",
    ]),
    # Sequences in which most rows repeat: one per device and app.
    "repeats": ("events", [
        "event_id AS id",
        "user_id AS device_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_type AS app",
        "CASE WHEN {k} % 10 = 0 THEN 'B' ELSE 'A' END AS title",
        "CASE WHEN {k} % 3 = 0 THEN NULL WHEN {k} % 20 >= 18 THEN 'u1' ELSE 'u0' END AS url",
        "concat('some words about ', event_type, ' and the number ', CAST({k} AS STRING),"
        " ' of the list') AS text",
        "round(value, 1) AS idle_s",
        "CAST({k} AS INT) AS k",
    ]),
    # Every event as a tick of its device.
    "ticks": ("events", [
        "user_id AS device_id",
        "CAST(ts AS TIMESTAMP) AS tick_ts",
        "value AS idle_s",
    ]),
    # Activity events in window and AFK buckets of four hosts.
    "activity": ("events", [
        "event_id",
        "user_id AS device_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "CASE WHEN event_type = 'error' THEN 'afk' ELSE 'window' END AS kind",
        "concat('host', CAST(user_id % 4 AS STRING)) AS host",
        "concat('aw-watcher-', CASE WHEN event_type = 'error' THEN 'afk' ELSE 'window' END,"
        " '_host', CAST(user_id % 4 AS STRING)) AS bucket",
        "event_type AS app",
        "value AS duration",
        "CASE WHEN {k} % 9 = 0 THEN NULL ELSE props END AS data",
    ]),
    # Windows on screen, in ticks of one day; z is the event's number.
    "observations": ("events", [
        "event_id AS id",
        "user_id AS device_id",
        "CAST(date_trunc('day', ts) AS TIMESTAMP) AS tick_ts",
        "event_id AS z",
        "CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 7 = 3 THEN 25 ELSE 0 END AS layer",
        "CASE {k} % 12 WHEN 0 THEN '1Password' WHEN 1 THEN 'BITWARDEN' WHEN 2 THEN 'Dock'"
        " WHEN 3 THEN '' WHEN 4 THEN 'Code' WHEN 5 THEN 'YouTube' ELSE event_type END AS app",
        "CAST({k} % 5 AS BIGINT) AS window_id",
        "CAST(100 + {k} % 4 AS INT) AS pid",
        "concat('t', CAST({k} % 3 AS STRING)) AS title",
        "CASE WHEN {k} % 13 = 1 THEN 'My Incognito tab' WHEN {k} % 13 = 2 THEN 'Saved  Passwords'"
        " WHEN {k} % 13 IN (3, 4) THEN '' WHEN {k} % 13 = 5 THEN '  padded title '"
        " ELSE concat('t', CAST({k} % 3 AS STRING)) END AS ax_title",
        "CASE WHEN {k} % 19 = 7 THEN 'bigIncognitoBrowserWindow' END AS identifier",
        "CASE WHEN {k} % 23 = 4 THEN 'Private area' END AS descr",
        "'AXStandardWindow' AS subrole",
        "{k} % 17 = 5 AS hidden",
        "event_type <> 'error' AS matched",
        "CASE WHEN {k} % 6 = 0 THEN 'file:///app/x.asar' WHEN {k} % 6 = 1 THEN NULL ELSE"
        " concat('https://ex.org/p', CAST({k} AS STRING), '?Token=abc&page=', CAST({k} AS STRING),"
        " '&flag', CASE WHEN {k} % 2 = 0 THEN '#frag?key=1' ELSE '' END) END AS page_url",
        "{list}(concat('line ', CAST({k} AS STRING)), 't0', 'line 1',"
        " concat('see https://h.io/a?key=', CAST({k} AS STRING), '&x=1, end'),"
        " CASE WHEN {k} % 10 = 9 THEN 'Show password' ELSE event_type END,"
        " concat('line ', CAST({k} AS STRING))) AS texts",
        "CAST({k} * 3 AS INT) AS bx",
        "CAST({k} * 2 AS INT) AS by_",
        "CAST(60 + {k} * 8 AS INT) AS bw",
        "CAST(80 + ({k} % 40) * 10 AS INT) AS bh",
        "round(value, 1) AS idle_s",
    ]),
    # Windows and elements of processes; an order is a process.
    "cg_windows": ("lineitem", [
        "l_orderkey AS pid",
        "l_linenumber * 10000000 + l_partkey AS window_id",
        "CASE WHEN l_suppkey % 4 = 0 THEN concat('doc', CAST(l_partkey % 50 AS STRING)) ELSE '' END"
        " AS title",
        "CAST(l_quantity * 20 AS INT) AS bx",
        "CAST(l_linenumber * 100 AS INT) AS by_",
        "CAST(200 + l_partkey % 300 AS INT) AS bw",
        "CAST(300 + l_suppkey AS INT) AS bh",
    ]),
    "ax_elements": ("lineitem", [
        "l_orderkey AS pid",
        "l_linenumber * 10000000 + l_partkey AS ax_order",
        "CASE WHEN l_suppkey % 8 = 0 THEN concat('doc', CAST(l_partkey % 50 AS STRING))"
        " WHEN l_suppkey % 8 = 1 THEN '' ELSE concat('other', CAST(l_partkey AS STRING)) END"
        " AS title",
        "CAST(l_quantity * 20 + l_suppkey % 7 - 3 AS INT) AS bx",
        "CAST(l_linenumber * 100 + l_partkey % 13 - 6 AS INT) AS by_",
        "CAST(200 + l_partkey % 300 + 5 AS INT) AS bw",
        "CAST(300 + l_suppkey - 2 AS INT) AS bh",
        "l_returnflag AS flag",
    ]),
    # Interface trees: each 64 parts are the nodes of one binary heap.
    "nodes": ("part", [
        "CAST(floor(p_partkey / 64) AS BIGINT) AS tree_id",
        "CAST(p_partkey % 64 + 1 AS BIGINT) AS node_id",
        "CASE WHEN p_partkey % 64 = 0 THEN NULL"
        " ELSE CAST(floor((p_partkey % 64 + 1) / 2) AS BIGINT) END AS parent_id",
        "CAST(length({bin}(CAST(p_partkey % 64 + 1 AS BIGINT))) - 1 AS INT) AS depth",
        "CAST(rpad(translate({bin}(CAST(p_partkey % 64 + 1 AS BIGINT)), '01', '12'), 7, '0')"
        " AS BIGINT) AS preorder",
        "CASE WHEN p_type = 'ECONOMY' AND p_partkey % 5 <> 0 THEN 'AXWebArea' ELSE 'AXGroup' END"
        " AS role",
        "CASE WHEN p_size % 12 = 3 THEN 'AXSecureTextField' ELSE 'AXOther' END AS subrole",
        "p_name AS value",
        "CASE WHEN p_size % 3 = 0 THEN concat(' ', p_brand, ' ') ELSE ' ' END AS title",
        "CASE WHEN p_size % 5 = 0 THEN p_type END AS descr",
    ]),
    # Summaries: three documents make one session.
    "summaries": ("documents", [
        "doc_id AS id",
        "CAST(floor(doc_id / 3) AS BIGINT) AS session_id",
        "text AS summary",
        "lang AS model",
        "CAST(n_chars AS BIGINT) AS tokens",
        "{ts}((1704067200 + doc_id * 60)) AS created_ts",
    ]),
    # Sessions that are known, by their label.
    "known_sessions": ("labels", [
        "doc_id AS id",
        "{ts}((1704067200 + doc_id * 60)) AS start_ts",
        "{ts}((1704067200 + doc_id * 60 + 30)) AS end_ts",
        "concat('q', CAST(quality AS STRING)) AS app",
    ]),
    # Turns of a conversation, three seconds apart, as captures of one window.
    "turns": ("conversations", [
        "conv_id AS device_id",
        "conv_id AS window_id",
        "turn AS id",
        "{ts}((1704067200 + turn * 3)) AS ts",
        "role AS app",
        "'conversation' AS title",
        "CAST(NULL AS STRING) AS url",
        "text",
    ]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # The source takes folders only; as a pattern, the path may also name a file.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def in_order(spark: SparkSession, df: DataFrame, *parts: str) -> DataFrame:
    """A stream of one micro-batch for each condition, taken one after the other.

    A micro-batch is a number of files, so every part has as many: all tasks write, and
    files without rows make up for those that had none to write.
    """
    base = f"{stage_folder(spark)}/source-{uuid.uuid4().hex}"
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.limit(0).coalesce(1).write.parquet(f"{base}/none")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop.Path(base).getFileSystem(conf)

    def written(folder: str) -> list:
        return [s.getPath() for s in files.listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-")]

    empty = written(f"{base}/none")[0]
    for n, part in enumerate(parts):
        folder = f"{base}/parts/{n}"
        df.filter(part).coalesce(most).write.parquet(folder)
        for i in range(most - len(written(folder))):
            hadoop.FileUtil.copy(files, empty, files, hadoop.Path(f"{folder}/part-none-{i}.parquet"), False, conf)
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", most)
        .option("recursiveFileLookup", "true").parquet(f"{base}/parts"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all cores, for costly work on each. The given tables come as
    one file with one row group each, which is one task; tables of many files
    need no dealing. Rows dealt by ``keys`` need no other shuffle to be grouped by them
    and more."""
    if keys:
        return df.repartition(*keys)
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A view by name, with all of its columns or those named."""
    return shaped(table(spark, sf_dir, VIEWS[name][0]), name, *columns)


def _named(expression: str) -> str:
    return expression.rsplit(" AS ", 1)[-1]


def shaped(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """A given table, or a stream of it, in the shape of a view, with bounds
    and paths as the operators want them."""
    expressions = VIEWS[name][1]
    if columns:
        by_name = {_named(e): e for e in expressions}
        expressions = [by_name[c] for c in columns]
    if any("{k}" in e for e in expressions):
        df = settle(df, _k=F.get_json_object("props", "$.k").cast("int"))
    df = df.selectExpr(*(e.format(**SPARK) for e in expressions))
    if "bx" in df.columns:
        df = df.withColumn(
            "bounds",
            F.struct(
                F.col("bx").alias("X"), F.col("by_").alias("Y"),
                F.col("bw").alias("Width"), F.col("bh").alias("Height"),
            ),
        ).drop("bx", "by_", "bw", "bh")
    if name == "nodes" and not columns:
        # The ancestors of heap node n are n/2, n/4, ...; the node ends the path.
        df = df.withColumn(
            "path",
            F.expr("transform(sequence(depth, 0, -1), i -> shiftright(node_id, i))"),
        )
    return df


def view_sql(name: str, spelling: dict[str, str]) -> str:
    """The same view as a SELECT for another engine."""
    source, expressions = VIEWS[name]
    return f"SELECT {', '.join(e.format(**spelling) for e in expressions)} FROM {source}"
