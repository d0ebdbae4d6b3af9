"""Timestamps: strict ISO-8601 reading, UTC text, local display, elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISPLAY_ZONE = "Asia/Makassar"
_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: Column | str) -> Column:
    """ISO-8601 date or date-time, optional fraction and offset, UTC when none is given."""
    c = _col(c)
    return F.when(c.rlike(_ISO), c.try_cast("timestamp"))


def iso_utc(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_utc_micros(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def utc_date(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def display_time(c: Column | str, zone: str = DISPLAY_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(_col(c), zone), "dd MMM yyyy, HH:mm")


def hours_between(start: Column | str, end: Column | str) -> Column:
    span = F.unix_micros(_col(end)) - F.unix_micros(_col(start))
    return span / F.lit(3_600_000_000.0)


def days_between(start: Column | str, end: Column | str) -> Column:
    return hours_between(start, end) / 24.0
