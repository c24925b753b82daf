"""Time helpers: elapsed micro-seconds / days, timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """end - start in micro-seconds (BIGINT); zone-less, no time-zone shift."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def ts_micros(ts: Column | str) -> Column:
    """Micro-seconds since 1970-01-01 of a zone-less timestamp."""
    return micros_between(epoch(), col(ts))


def micros_to_ts(us: Column) -> Column:
    """Inverse of ts_micros: BIGINT micro-seconds -> timestamp_ntz."""
    return F.timestamp_add("MICROSECOND", us, epoch())


def days_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(float(US_PER_DAY))


def parse_ts(c: Column | str, fmt: str | None = None) -> Column:
    """Text -> timestamp_ntz; unparseable -> NULL (never an error)."""
    c = col(c)
    if fmt:
        return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("timestamp_ntz")
    return c.cast("string").try_cast("timestamp_ntz")


def ntz_lit(v) -> Column:
    """Zone-less timestamp literal from a Python datetime / date / ISO text.

    Built from ISO text, so neither the Python process zone nor the session
    zone can shift it."""
    if v is None:
        return F.lit(None).cast("timestamp_ntz")
    if hasattr(v, "isoformat"):
        v = v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return F.lit(str(v)).cast("timestamp_ntz")
