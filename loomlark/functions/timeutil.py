"""Dates, ISO weeks and timestamps of the log dialects."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(d: Column) -> Column:
    """``YYYY-Www`` of a date."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def monday(d: Column) -> Column:
    return F.trunc(d, "week")


def week_days(week: Column) -> Column:
    """The seven dates of an ISO week id. 4 January lies in week 1."""
    first = F.trunc(F.make_date(F.substring(week, 1, 4).cast("int"), F.lit(1), F.lit(4)), "week")
    start = F.date_add(first, (F.substring(week, 7, 2).cast("int") - 1) * 7)
    return F.sequence(start, F.date_add(start, 6))


def valid_month(c: Column) -> Column:
    return c.rlike(r"\A\d{4}-(0[1-9]|1[0-2])\z")


def valid_day(c: Column) -> Column:
    """Shape first: the cast alone would accept shorter forms."""
    return c.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & c.try_cast("date").isNotNull()


def uuid7_time(u: Column) -> Column:
    """Time of a version 7 UUID: its first 48 bits are milliseconds."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(u, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def any_timestamp(c: Column) -> Column:
    """RFC 3339, a date and time without zone (UTC), or epoch seconds; null if none fits."""
    number = c.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("long"))), c.try_cast("timestamp"))


def within(month: Column, day: Column, start: str | None, end: str | None) -> Column:
    """Inclusive bounds, each ``YYYY-MM`` or ``YYYY-MM-DD``. The month always counts; the day counts only where there is
    one and the bound names one. A row without month passes only when there is no bound."""
    ok = F.lit(True)
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            if len(bound) not in (7, 10):
                raise ValueError(f"not a month or a day: {bound}")
            ok = ok & month.isNotNull() & keep(month, bound[:7])
            if len(bound) == 10:
                ok = ok & (day.isNull() | keep(day, bound))
    return ok


def bounds(month: str | None = None, start: str | None = None, end: str | None = None, days: int | None = None, today: date | None = None) -> tuple[str | None, str | None]:
    """Start and end for ``within``: a month beats the other bounds, and a number of days before today (UTC; 0: today) beats the start."""
    if month is not None:
        return month, month
    if days is not None:
        start = ((today or datetime.now(timezone.utc).date()) - timedelta(days=days)).isoformat()
    return start, end
