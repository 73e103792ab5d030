"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom import settings as S


def parse_ts(col: Column) -> Column:
    """ISO-8601 text to an instant; ``Z`` and offsets alike, none means UTC.

    Text that is no timestamp gives NULL instead of failing the job.
    """
    return F.try_to_timestamp(col)


def iso(ts: Column) -> Column:
    """An instant as ISO-8601 text in UTC, with microseconds where it has any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(micros != ".000000", micros).otherwise(""), F.lit("+00:00"))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds_between(a: Column, b: Column) -> Column:
    """Absolute distance of two instants in seconds, with fractions."""
    return F.abs(F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def bucket_id(kind: Column, host: Column) -> Column:
    """Key of the event bucket that one watcher fills on one host."""
    return F.concat(F.lit(f"{S.BUCKET_PREFIX}-"), kind, F.lit("_"), host)
