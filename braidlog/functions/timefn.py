"""Instants and days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def millis(text: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 text; 0 where missing or unreadable."""
    return F.coalesce(F.when(text.rlike(RFC3339), F.unix_millis(F.try_to_timestamp(text))), F.lit(0))


def strict_day(text: str) -> date:
    """A day written YYYY-MM-DD; ValueError otherwise."""
    if len(text) != 10:
        raise ValueError(f"not a date: {text!r}")
    return date.fromisoformat(text)


def midnight_millis(day: date, zone: str) -> Column:
    """First instant of a day in a zone, over gaps of the clock too, whatever the session's zone."""
    return F.unix_millis(F.make_timestamp(F.lit(day.year), F.lit(day.month), F.lit(day.day), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit(zone)))


def local_day(ms: Column, zone: str = "UTC") -> Column:
    """Day of an instant in a zone, as text, whatever the session's zone."""
    wall = F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone))  # a shift of the instant, in no zone
    return F.date_from_unix_date(F.floor(wall / 86_400_000).cast("int")).cast("string")
