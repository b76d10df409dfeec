"""Request times: a fixed-position check and day arithmetic that lets days overflow into the next month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, T, time, and at least one further character, which is ignored together with all that follows.
SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?s:.)"
_AT = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2), "minute": (15, 2), "second": (18, 2)}


def part(text: Column, name: str) -> Column:
    """A field of a time as a number; null where the text has no digits there."""
    return F.substring(text, *_AT[name]).try_cast("int")


def is_time(text: Column) -> Column:
    """Whether a text is a time of the fixed shape within range; null is not."""
    inside = part(text, "month").between(1, 12) & part(text, "day").between(1, 31) & (part(text, "hour") <= 23) & (part(text, "minute") <= 59) & (part(text, "second") <= 59)
    return F.coalesce(text.rlike(SHAPE) & inside, F.lit(False))


def civil_date(text: Column) -> Column:
    """Date of a valid time; day 31 of a short month is a day of the next month."""
    year, month = part(text, "year"), part(text, "month")
    first = F.when((month >= 1) & (month <= 12) & (year >= 1), F.make_date(year, month, F.lit(1)))
    zero = F.when((month >= 1) & (month <= 12) & (year == 0), F.date_add(F.make_date(F.lit(400), month, F.lit(1)), -146_097))
    return F.date_add(F.coalesce(first, zero), part(text, "day") - 1)


def civil_days(text: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(civil_date(text))


def weekday(text: Column) -> Column:
    """Monday 0 to Sunday 6."""
    return F.weekday(civil_date(text))


def epoch_seconds(text: Column) -> Column:
    day = civil_days(text).cast("long") * 86_400
    return day + part(text, "hour") * 3600 + part(text, "minute") * 60 + part(text, "second")


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes between two valid times, whichever is later."""
    return F.floor(F.abs(epoch_seconds(a) - epoch_seconds(b)) / 60).cast("long")
