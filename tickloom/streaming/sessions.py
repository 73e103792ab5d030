"""Sessions as they end."""

from pyspark.sql import DataFrame, functions as F

from tickloom import settings as S
from tickloom.functions.times import seconds_between


def ended_sessions(
    captures: DataFrame, gap_s: float = S.SESSION_GAP_S, late: str = "1 minute", ts: str = "ts", tie: str = "id",
) -> DataFrame:
    """``operators.sessions.sessions`` over a stream: a session is given once no capture
    can continue it any more, that is when the watermark is ``gap_s`` past its end.

    Another app or title is another session; state is kept by device, app and title.
    Captures later than ``late`` are dropped. On a table, all sessions.
    """
    if captures.isStreaming:
        captures = captures.withWatermark(ts, late)
    keys = ["device_id", "app", "title"]
    first = F.struct(ts, tie)
    gap = f"{round(gap_s * 1_000_000)} microseconds"
    return (
        captures.groupBy(*keys, F.session_window(ts, gap).alias("_span"))
        .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
             F.min_by(F.struct("url"), first)["url"].alias("url"), F.count(F.lit(1)).alias("capture_count"))
        .select(*keys, "start_ts", "end_ts", "url", "capture_count",
                seconds_between(F.col("start_ts"), F.col("end_ts")).alias("duration_s"))
    )
