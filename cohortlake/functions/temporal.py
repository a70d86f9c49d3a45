"""Day periods: closed intervals of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(text: Column) -> Column:
    """The date of a FHIR date or dateTime as written; NULL for anything coarser than a day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def instant_day(text: Column, zone: str = "UTC") -> Column:
    """The date of an instant in a time zone."""
    return F.from_utc_timestamp(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()), zone).cast("date")


def period(start: Column, end: Column | None = None) -> Column:
    """STRUCT<start, end> of dates; one date stands for that day; NULL if an end is missing or they are reversed."""
    end = start if end is None else end
    return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))


def element_period(body: Column, path: str, zone: str = "UTC") -> Column:
    """STRUCT<start, end> of the date, dateTime, instant or Period at a JSON path, or of a choice of them (`x` stands for
    `xDateTime`, `xPeriod`, `xInstant` as well).
    """
    at = lambda suffix: F.get_json_object(body, path + suffix)
    one = F.coalesce(day(at("DateTime")), instant_day(at("Instant"), zone), day(at("")))
    return F.coalesce(period(one), period(day(at(".start")), day(at(".end"))), period(day(at("Period.start")), day(at("Period.end"))))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def within(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether period a lies in period b."""
    return (b_start <= a_start) & (a_end <= b_end)


def starts_inside(start: Column, b_start: Column, b_end: Column) -> Column:
    """Whether a period that starts there starts after b does and not after b ends."""
    return (b_start < start) & (start <= b_end)


def compare(comparator: str, left: Column, right: Column) -> Column:
    """A quantity comparison by its code: eq, lt, le, gt, ge."""
    return {"eq": left == right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}[comparator]
