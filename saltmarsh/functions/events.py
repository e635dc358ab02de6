"""Column functions of lists of events: periods, titles, written times."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.text import empty

#: A range that lies behind the reference day falls back to so many days.
FALL_BACK = 90
#: The label of each collector's rows, and the nature of posts that old rows without a source have (fixed values).
LABELS, LEAK = {"ransom": "랜섬웨어", "telegram": "텔레그램", "forum": "포럼"}, "랜섬웨어 유출"
#: What a period is: ("days", n), ("all",) or ("range", first day, last day).
Period = tuple


def clamped(period: Period, now: datetime.datetime) -> tuple[str, str] | None:
    """The days of a range, the last not behind the day of now (UTC); None if that turns it round, or for other periods."""
    if period[0] != "range":
        return None
    last = min(period[2], now.date().isoformat())
    return (period[1], last) if period[1] <= last else None


def period_days(period: Period, now: datetime.datetime) -> tuple[str | None, str]:
    """First and last day of a period; the first is None for all."""
    found = clamped(period, now)
    if found or period[0] == "all":
        return found or (None, now.date().isoformat())
    days = period[1] if period[0] == "days" else FALL_BACK
    return (now - datetime.timedelta(days=days) + datetime.timedelta(milliseconds=1)).date().isoformat(), now.date().isoformat()


def instant(written: Column) -> Column:
    """The time that an ISO text names: with its offset, as UTC without one, at midnight UTC without a time; null for others."""
    return F.try_to_timestamp(F.when(written.rlike(r"T.*(Z|[+-][0-9]{2}:?[0-9]{2})$"), written).when(written.contains("T"), F.concat(written, F.lit("Z"))).otherwise(F.concat(written, F.lit("T00:00:00Z"))))


def in_period(written: Column, period: Period, now: datetime.datetime) -> Column:
    """Whether an event lies in period: by instants for days and all, by the day as written for a range. Never behind now."""
    at, end = instant(written), F.lit(now.replace(tzinfo=datetime.UTC))
    found = clamped(period, now)
    if found:
        inside = F.substring(written, 1, 10).between(*found)
    elif period[0] == "all":
        inside = F.lit(True)
    else:
        inside = at > F.lit((now - datetime.timedelta(days=period[1] if period[0] == "days" else FALL_BACK)).replace(tzinfo=datetime.UTC))
    return F.coalesce(inside & (at <= end), F.lit(False))


def newest_first(written: Column, tie: Column) -> list[Column]:
    """An order: by the text to the minute, then by the instant, both newest first, then by tie."""
    return [F.substring(written, 1, 16).desc(), instant(written).desc(), tie.asc()]


def utc_stamp(written: Column) -> Column:
    """The time in UTC to the minute; the day as written if it has no time."""
    at = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant(written).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")
    return F.coalesce(F.when(written.rlike("T[0-9]{2}:[0-9]{2}"), F.concat(at, F.lit(" UTC"))), F.substring(written, 1, 10))


def size_text(value: Column, unit: Column) -> Column:
    """Counts with commas, other sizes to two decimals, then the unit; null without either."""
    number = F.when(unit == "건", F.call_function("format_number", value, F.lit("#,##0.###"))).otherwise(F.call_function("format_number", F.floor(value * 100 + 0.5) / 100, F.lit("0.##")))
    return F.when(empty(unit) != "", F.concat(number, unit))


def title(country: Column, industry: Column, written: Column, value: Column, unit: Column) -> Column:
    """What is known of country, industry, day and size, in brackets."""
    parts = [F.when(empty(c) != "", c) for c in (country, industry, F.substring(written, 1, 10), size_text(value, unit))]
    return F.concat(F.lit("["), F.concat_ws(" · ", *parts), F.lit("]"))


def of_source(source: Column, nature: Column, wanted: str) -> Column:
    """Whether a row is of the wanted collector; one whose source is blank only by the nature of ransom leaks."""
    if wanted == "all":
        return F.lit(True)
    own = F.trim(empty(source))
    return F.when(own != "", own == LABELS.get(wanted, "")).otherwise(F.coalesce(nature == LEAK, F.lit(False)) if wanted == "ransom" else F.lit(False))
