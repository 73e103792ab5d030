"""Activity of the last minutes, kept up to date."""

from pyspark.sql import DataFrame, functions as F

from tickloom import settings as S


def rolling_activity(
    events: DataFrame,
    length: str = f"{S.RECENT_MINUTES} minutes",
    every: str = "1 minute",
    late: str = "10 minutes",
) -> DataFrame:
    """Events and their time per bucket over sliding windows.

    Works on tables and on streams; on a stream, rows later than ``late`` are
    dropped and windows are final once the watermark has passed them.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return (
        events.groupBy("bucket", F.window("ts", length, every).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum("duration").alias("total_s"))
        .select(
            "bucket",
            F.col("_w")["start"].alias("window_start"),
            F.col("_w")["end"].alias("window_end"),
            "n_events", "total_s",
        )
    )
