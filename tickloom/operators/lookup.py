"""Reads over stored tables: by id, time, app, newest, latest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom import settings as S


def by_id(df: DataFrame, row_id: int, id_column: str = "id") -> DataFrame:
    """The row with this id, or no row."""
    return df.filter(F.col(id_column) == row_id)


def _within(df: DataFrame, ts: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    if "date" in df.columns:
        # Stored tables are partitioned by date: read only the days concerned.
        df = df.filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def captures_between(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Captures within [start, end], oldest first."""
    return _within(df, "ts", start, end).orderBy("ts", "id")


def sessions_between(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Sessions that *start* within [start, end], oldest first."""
    return _within(df, "start_ts", start, end).orderBy("start_ts", "id")


def captures_during(
    df: DataFrame, spans: DataFrame, start: str = "start_ts", end: str = "end_ts", ts: str = "ts"
) -> DataFrame:
    """Captures within any of the spans [start, end], each once; of any device, or of the
    span's own where spans have one.

    Met by day. On a stored table only the days of the spans are read: Spark learns them
    when it has the spans (dynamic pruning).
    """
    keys = [c for c in ["device_id"] if c in spans.columns and c in df.columns]
    dated = df if "date" in df.columns else df.withColumn("date", F.to_date(ts))
    days = spans.filter(F.col(start) <= F.col(end)).select(
        *(F.col(c).alias(f"_{c}") for c in keys), F.col(start).alias("_start"), F.col(end).alias("_end"),
        F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("_date"))
    inside = (F.col("date") == F.col("_date")) & F.col(ts).between(F.col("_start"), F.col("_end"))
    for c in keys:
        inside = inside & (F.col(c) == F.col(f"_{c}"))
    return dated.join(days, inside, "left_semi").select(*df.columns)


def captures_by_app(df: DataFrame, app: str, limit: int = S.CAPTURE_LIMIT) -> DataFrame:
    """Newest captures of one app; the name is compared with its case."""
    return df.filter(F.col("app") == app).orderBy(F.col("ts").desc(), "id").limit(limit)


def most_recent(df: DataFrame, limit: int = S.CAPTURE_LIMIT) -> DataFrame:
    """Newest captures."""
    return df.orderBy(F.col("ts").desc(), "id").limit(limit)


def latest_per(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str = "ts", tie: str = "id"
) -> DataFrame:
    """``columns`` of the newest row of every key. Combines map-side."""
    newest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(ts, tie)).alias("_row")
    )
    return newest.select(*keys, *(F.col("_row")[c].alias(c) for c in columns))


def frontmost(observations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The window in front, for every tick of every device."""
    front = observations.groupBy("device_id", "tick_ts").agg(
        F.min_by(F.struct(*columns), "z").alias("_row")
    )
    return front.select("device_id", "tick_ts", *(F.col("_row")[c].alias(c) for c in columns))


def summaries_for(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of the given sessions, oldest first within a session."""
    ids = sessions.select(F.col("id").alias("session_id"))
    return summaries.join(ids, "session_id", "left_semi").orderBy("session_id", "created_ts", "id")
