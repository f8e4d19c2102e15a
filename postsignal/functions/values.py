"""Column functions for times, counters, links and the list <-> text codec."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

# ISO-8601: a calendar or week date, then optionally any one character, a time and an offset.
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?)"
_TIME = r"(\d{2}(?::\d{2}(?::\d{2})?)?|\d{4}(?:\d{2})?)(?:[.,](\d+))?"
_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2})?)?"
ISO = rf"^{_DATE}(?:.{_TIME}{_OFFSET})?$"

# Permalink formats of the two search clients.
LINK_BY_ID = "https://twitter.com/i/web/status/"
LINK_BY_USER = "https://twitter.com/{username}/status/{id}"


def utc(value: datetime) -> datetime:
    """The instant of a datetime; one without a zone is UTC, whatever zone the driver is in."""
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value


def as_column(value: Column | datetime | None) -> Column:
    """A time as a column; None is the time of the batch or query that runs."""
    if value is None:
        return F.current_timestamp()
    return value if isinstance(value, Column) else F.lit(utc(value))


def parse_iso(c: Column) -> Column:
    """ISO-8601 date or date-time as an instant; null when it is anything else.

    Basic, extended and week forms, times cut after any unit, offsets with or
    without a colon; digits beyond microseconds are cut off. Times without an
    offset are UTC.
    """
    part = lambda n: F.regexp_extract(c, ISO, n)
    digits = lambda n: F.regexp_replace(part(n), "[^0-9]", "")
    day, clock, offset = digits(1), F.rpad(digits(2), 6, "0"), digits(4)
    year, week = F.substring(day, 1, 4).try_cast("int"), F.substring(day, 5, 2).try_cast("int")
    weekday = F.coalesce(F.nullif(F.substring(day, 7, 1), F.lit("")).try_cast("int"), F.lit(1))
    # Week 1 holds the fourth of January; a week the year lacks falls into another year.
    monday = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)))
    by_week = F.date_add(monday.cast("date"), (week - 1) * 7 + weekday - 1)
    by_week = F.when((week >= 1) & (F.extract(F.lit("YEAROFWEEK"), by_week) == year), F.date_format(by_week, "yyyyMMdd"))
    calendar = F.when(part(1).contains("W"), by_week).otherwise(day)
    zone = F.when(offset == "", F.lit("Z")).otherwise(
        F.concat(F.substring(part(4), 1, 1), F.substring(offset, 1, 2), F.lit(":"), F.rpad(F.substring(offset, 3, 2), 2, "0"))
    )
    pair = lambda text, at: F.substring(text, at, 2)
    date = F.concat(F.substring(calendar, 1, 4), F.lit("-"), pair(calendar, 5), F.lit("-"), pair(calendar, 7))
    time = F.concat_ws(":", pair(clock, 1), pair(clock, 3), pair(clock, 5))
    spelled = F.concat(date, F.lit("T"), time, F.lit("."), F.rpad(F.substring(part(3), 1, 6), 6, "0"), zone)
    return F.try_to_timestamp(F.when(F.rlike(c, F.lit(ISO)), spelled))


def normalize_timestamp(c: Column, as_of: Column | datetime) -> Column:
    """Parsed instant, or `as_of` (one value per run) when missing or unreadable."""
    return F.coalesce(parse_iso(c), as_column(as_of).cast("timestamp"))


def coerce_count(c: Column) -> Column:
    """Whole number in a text column: absent is 0, a present non-number is null."""
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    whole = F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), text).try_cast("bigint")
    return F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(whole)


def truncate_count(c: Column) -> Column:
    """Numeric column to whole numbers, towards zero; absent is 0, overflow null."""
    return F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(c.try_cast("bigint"))


def link_by_id(post_id: Column) -> Column:
    return F.concat(F.lit(LINK_BY_ID), F.coalesce(post_id.cast("string"), F.lit("None")))


def link_by_user(username: Column, post_id: Column) -> Column:
    """Null when the id is null."""
    head, middle = LINK_BY_USER.removesuffix("{id}").split("{username}")
    return F.concat(F.lit(head), username, F.lit(middle), post_id.cast("string"))


def encode_list(a: Column) -> Column:
    return F.array_join(a, ",")


def decode_list(c: Column) -> Column:
    """Inverse of `encode_list`, except that a comma inside an element splits it."""
    return F.when(c != "", F.split(c, ",")).otherwise(F.array().cast("array<string>"))
