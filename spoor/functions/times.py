"""Clock conversions: every artifact clock to a Spark TIMESTAMP, and back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distance between the 1601 and 1970 epochs, and the accepted range.
EPOCH_GAP_US = 11_644_473_600_000_000
EARLIEST_US = -8_520_336_000_000_000  # 1700-01-01
LATEST_US = 4_102_444_800_000_000  # 2100-01-01


def _in_range(us: Column, given: Column) -> Column:
    return F.when(
        (given > 0) & us.between(EARLIEST_US, LATEST_US), F.timestamp_micros(us)
    )


def filetime_ts(c: Column) -> Column:
    """100 ns ticks since 1601; null for zero, negative or out-of-range values."""
    ticks = c.cast("bigint")
    return _in_range(_whole(ticks) - EPOCH_GAP_US, ticks)


def _whole(ticks: Column) -> Column:
    # exact 64-bit division: a double cannot hold 18 digits
    return F.call_function("div", ticks, F.lit(10)).cast("bigint")


def webkit_ts(c: Column) -> Column:
    """Microseconds since 1601."""
    us = c.cast("bigint")
    return _in_range(us - EPOCH_GAP_US, us)


def unix_us_ts(c: Column) -> Column:
    """Microseconds since 1970."""
    us = c.cast("bigint")
    return _in_range(us, us)


def iso_z(c: Column) -> Column:
    """Second-precision ISO text with a ``Z``, whatever the session zone is."""
    utc = F.to_utc_timestamp(c, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_iso(c: Column) -> Column:
    """Epoch seconds to ISO text; null for null and for 0."""
    return F.when(c != 0, iso_z(F.timestamp_seconds(c)))


def parse_iso(c: Column) -> Column:
    """ISO text (T or blank, optional fraction, optional Z, or a bare date) to TIMESTAMP."""
    text = F.replace(F.rtrim(F.trim(c), F.lit("Z")), F.lit(" "), F.lit("T"))
    moment = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$"
    day = r"^\d{4}-\d{1,2}-\d{1,2}$"
    return F.when(text.rlike(moment), F.concat(text, F.lit("Z")).try_cast("timestamp")).when(
        text.rlike(day), F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp")
    )


def first_iso(c: Column) -> Column:
    """The first whole ISO stamp inside a line, as text."""
    found = F.regexp_extract(c, r"\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)\b", 1)
    return F.nullif(found, F.lit(""))
