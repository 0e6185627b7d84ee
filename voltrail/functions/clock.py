"""Times, gaps and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Seconds in each part of an ISO-8601 duration (a year is 365.25 days, a month a twelfth of it).
DATE_PART_SECONDS = {"Y": 31557600.0, "M": 2629800.0, "D": 86400.0}
TIME_PART_SECONDS = {"H": 3600.0, "M": 60.0, "S": 1.0}


def duration_seconds(text: Column) -> Column:
    """Seconds in an ISO-8601 duration such as ``P1DT2H3.5S``, as float32; weeks are ignored."""
    parts = ((F.split_part(text, F.lit("T"), F.lit(1)), DATE_PART_SECONDS),
             (F.split_part(text, F.lit("T"), F.lit(2)), TIME_PART_SECONDS))
    total = F.lit(0.0)
    for part, units in parts:
        for letter, seconds in units.items():
            number = F.regexp_extract(part, rf"([0-9.]+){letter}", 1).try_cast("double")
            present = F.contains(part, F.lit(letter))  # spares most rows most patterns
            total = total + F.coalesce(F.when(present, number * seconds), F.lit(0.0))
    return F.when(text.isNotNull(), total).cast("float")


def seconds_between(first: Column, second: Column) -> Column:
    """Whole seconds from ``first`` to ``second``, cut toward zero."""
    return ((F.unix_micros(second) - F.unix_micros(first)) / 1e6).cast("long")


def hours_between(first: Column, second: Column) -> Column:
    return (F.unix_seconds(second) - F.unix_seconds(first)) / 3600


def parse_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp from text; text that does not fit the pattern gives null."""
    return F.try_to_timestamp(text, F.lit(pattern))


def corrected_time(ts: Column, rts: Column, close_ts: Column, close_rts: Column) -> Column:
    """Place a message by its distance to the session's close; falls back to its own time."""
    known = close_ts.isNotNull() & close_rts.isNotNull() & rts.isNotNull()
    back = F.bround(close_rts.cast("double") - rts.cast("double")).cast("int")
    return F.when(known, F.timestamp_add("SECOND", -back, close_ts)).otherwise(ts)


def near_midnight(ts: Column, before_min: int = 30, after_min: int = 30) -> Column:
    """Late in hour 23 or early in hour 0, by whole minutes."""
    late = (F.hour(ts) == 23) & (F.minute(ts) >= 60 - before_min)
    early = (F.hour(ts) == 0) & (F.minute(ts) <= after_min)
    return late | early


def near_midnight_exact(ts: Column, before_min: int = 30, after_min: int = 10) -> Column:
    """As :func:`near_midnight`, with the margin after midnight counted in seconds."""
    since_midnight = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
    late = (F.hour(ts) == 23) & (F.minute(ts) >= 60 - before_min)
    return (since_midnight <= after_min * 60 * 1_000_000) | late
