"""Activity events: buckets, reads, records, recent activity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom import settings as S

WINDOW, AFK = "window", "afk"


def bucket_name(kind: str, host: str) -> str:
    """Key of one watcher's bucket on one host."""
    return f"{S.BUCKET_PREFIX}-{kind}_{host}"


def read_events(
    events: DataFrame,
    bucket: str,
    limit: int = S.EVENT_LIMIT,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """Events of one bucket within [start, end], newest first.

    ``limit=-1`` reads them all. An unknown bucket gives no rows.
    """
    found = events.filter(F.col("bucket") == bucket)
    if start is not None:
        found = found.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        found = found.filter(F.col("ts") <= F.lit(end))
    found = found.orderBy(F.col("ts").desc(), F.col(tie).desc())
    return found if limit < 0 else found.limit(limit)


def read_window_events(events: DataFrame, host: str, **options) -> DataFrame:
    return read_events(events, bucket_name(WINDOW, host), **options)


def read_afk_events(events: DataFrame, host: str, **options) -> DataFrame:
    return read_events(events, bucket_name(AFK, host), **options)


def list_buckets(events: DataFrame) -> DataFrame:
    """Every bucket with its kind, size and time span."""
    kind = F.regexp_extract(F.col("bucket"), rf"^{S.BUCKET_PREFIX}-([^_]+)_", 1)
    return events.groupBy("bucket", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def to_records(events: DataFrame, *extra: str) -> DataFrame:
    """Events in the record shape shared with captures; no data becomes ``{}``.

    A duration given as an interval is turned into seconds.
    """
    duration = F.col("duration")
    if dict(events.dtypes)["duration"].startswith("interval"):
        duration = F.expr(
            "extract(DAY FROM duration) * 86400D + extract(HOUR FROM duration) * 3600D"
            " + extract(MINUTE FROM duration) * 60D"
            " + CAST(extract(SECOND FROM duration) AS DOUBLE)"
        )
    return events.select(
        *extra,
        "ts",
        F.lit(S.EVENT_SOURCE).alias("source"),
        "bucket",
        duration.cast("double").alias("duration"),
        F.coalesce("data", F.lit("{}")).alias("data"),
    )


def recent_activity(
    events: DataFrame,
    hosts: list[str] | None = None,
    minutes: float = S.RECENT_MINUTES,
    now: dt.datetime | None = None,
    extra: tuple[str, ...] = ("event_id",),
) -> DataFrame:
    """Window and AFK events of the last minutes, both bounds included, in
    time order. ``now`` defaults to the newest event."""
    parts = []
    for kind in (WINDOW, AFK):
        if hosts is None:
            part = events.filter(F.col("bucket").startswith(f"{S.BUCKET_PREFIX}-{kind}_"))
        else:
            part = events.filter(F.col("bucket").isin([bucket_name(kind, h) for h in hosts]))
        parts.append(to_records(part, *extra))
    both = parts[0].unionByName(parts[1])
    span = F.make_dt_interval(secs=F.lit(round(minutes * 60, 6)))
    if now is not None:
        recent = both.filter((F.col("ts") >= F.lit(now) - span) & (F.col("ts") <= F.lit(now)))
    else:
        newest = events.agg(F.max("ts")).scalar()
        recent = both.filter(F.col("ts") >= newest - span)
    return recent.orderBy("ts", *extra)


LOG = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("source", T.StringType()),
    T.StructField("payload", T.StringType()), T.StructField("date", T.DateType()),
])


def merge_streams(captures: DataFrame, records: DataFrame) -> DataFrame:
    """Captures and event records as one log, tagged by source and dated."""
    screen = captures.select(
        "ts", F.lit("screen").alias("source"),
        F.to_json(F.struct("app", "title", "text")).alias("payload"),
    )
    activity = records.select(
        "ts", "source", F.to_json(F.struct("bucket", "duration", "data")).alias("payload")
    )
    return screen.unionByName(activity).withColumn("date", F.to_date("ts"))


def write_log(log: DataFrame, path: str) -> None:
    """Write a dated log as JSON lines, one folder for each day.

    The days of ``log`` are replaced as a whole and others stay, so a day can be written
    again. Crowded days become several files of the advised size, small ones one.
    """
    (
        log.hint("rebalance", F.col("date")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").partitionBy("date").json(path)
    )


def read_log(
    spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """The log, or its days from ``first`` to ``last``; other days are not read."""
    log = spark.read.schema(LOG).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    if first is not None:
        log = log.filter(F.col("date") >= F.lit(first))
    if last is not None:
        log = log.filter(F.col("date") <= F.lit(last))
    return log
