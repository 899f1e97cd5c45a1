"""Event time parsing to naive UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant_to_ntz(text: Column) -> Column:
    """ISO-8601 with an offset (or none, read as UTC) to naive UTC; junk gives null.

    Relies on the session zone being UTC, which ``build_session`` sets.
    """
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def millis_to_ntz(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def event_start(event_date: Column) -> Column:
    """Start of an ``a/b`` range, or the whole text."""
    return F.get(F.split(event_date, "/"), F.lit(0))


def event_instant(event_date: Column) -> Column:
    """Naive UTC time of an event that names one, else null."""
    first = event_start(event_date)
    return F.when(first.contains("T"), instant_to_ntz(first))


def event_day(event_date: Column, year: Column, month: Column, day: Column) -> Column:
    """Event date: from the text when it holds one, else from year, month, day."""
    first = event_start(event_date)
    from_text = F.when(first.contains("T"), event_instant(event_date).cast("date")).when(
        F.length(first) >= 10, F.left(first, F.lit(10)).try_cast("date")
    )
    return F.coalesce(from_text, F.try_make_date(year, month, day) if hasattr(F, "try_make_date") else _day(year, month, day))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")
