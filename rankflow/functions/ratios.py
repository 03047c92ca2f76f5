"""Percentages, bands and time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ((5, "under_5"), (25, "under_25"), (50, "under_50"))
TOP_BAND = "50_or_more"


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` in double; null for a zero whole."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def band(share: Column) -> Column:
    """Four bands of a percentage."""
    labels = [F.when(share < limit, label) for limit, label in BANDS]
    return F.coalesce(*labels, F.when(share.isNotNull(), TOP_BAND))


def clock(cycles: Column, mhz: float) -> Column:
    """Cycles at ``mhz`` as ``HH:MM:SS:mmm``, hours wrapping at 24."""
    millis = F.floor(cycles / F.lit(mhz * 1000.0))

    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    return F.concat_ws(
        ":",
        two(F.floor(millis / 3600000) % 24),
        two(F.floor(millis / 60000) % 60),
        two(F.floor(millis / 1000) % 60),
        F.lpad((millis % 1000).cast("string"), 3, "0"),
    )


def leading_digits(number: Column, count: int) -> Column:
    """The first ``count`` digits of an integer."""
    return F.substring(number.cast("string"), 1, count).cast("int")


def span_ns(end_sec: Column, end_nsec: Column, start_sec: Column, start_nsec: Column) -> Column:
    """Difference of two (seconds, nanoseconds) stamps in nanoseconds."""
    return (end_sec - start_sec) * F.lit(1_000_000_000) + end_nsec - start_nsec


def micros(stamp: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    return F.unix_micros(stamp.cast("timestamp"))


def hundredths(amount: str | Column) -> Column:
    """A two-digit amount as a whole number, so that sums are exact."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.round(amount * 100).cast("bigint")
