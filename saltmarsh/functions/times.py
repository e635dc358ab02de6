"""Days, months and quarters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days are those of this zone, unless a caller says otherwise.
ZONE = "Asia/Seoul"
#: Label of rows without a day (fixed value).
NO_DAY = "(미상)"


def local_day(at: Column, zone: str = ZONE) -> Column:
    """The calendar day of a UTC timestamp in zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def month_label(day: Column) -> Column:
    """yyyy-MM, or the label for no day."""
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NO_DAY))


def quarter_key(day: Column) -> Column:
    """yyyy-Qn: its order as text is its order in time."""
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def quarter_end(day: Column) -> Column:
    """The last day of the quarter of day."""
    return F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1)


def snowflake_time(number: Column) -> Column:
    """The UTC time in a post number that carries milliseconds since its epoch in the upper bits (fixed value)."""
    return F.timestamp_millis(F.shiftrightunsigned(number, 22) + F.lit(1288834974657))


def countdown_seconds(text: Column) -> Column:
    """Seconds that a countdown such as "19일 7시간", "9 days 3 hours" or "9d 03:14:37" has left; null if it is none."""

    def figure(unit: str) -> Column:
        found = F.regexp_extract(F.lower(text), rf"(\d+)\s*(?:{unit})", 1)
        return F.nullif(found, F.lit("")).cast("long")

    days, hours, minutes, seconds = figure("일|days?|d\\b"), figure("시간|hours?|hrs?|h\\b"), figure("분|minutes?|mins?|m\\b"), figure("초|seconds?|secs?|s\\b")
    clock = F.regexp_extract(text, r"(\d{1,3}):(\d{2}):(\d{2})", 0)
    part = F.split(clock, ":")
    of_clock = F.when(clock != "", F.get(part, F.lit(0)).cast("long") * 3600 + F.get(part, F.lit(1)).cast("long") * 60 + F.get(part, F.lit(2)).cast("long"))
    any_figure = F.coalesce(days, hours, minutes, seconds, of_clock)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.when(any_figure.isNotNull(), zero(days) * 86400 + zero(hours) * 3600 + zero(minutes) * 60 + zero(seconds) + zero(of_clock))


def expiry_from(observed_at: Column, countdown: Column) -> Column:
    """When a countdown read at observed_at runs out."""
    return F.timestamp_seconds(F.unix_timestamp(observed_at) + countdown_seconds(countdown))


def day_gap(later: Column, earlier: Column) -> Column:
    """Days from earlier to later, negative if the order is the other way."""
    return F.datediff(later, earlier)


def interval_text(minutes: Column) -> Column:
    """A mean interval in words: minutes, hours or days with one decimal."""
    return (
        F.when(minutes.isNull(), F.lit(None).cast("string"))
        .when(minutes < 60, F.concat(F.round(minutes).cast("long").cast("string"), F.lit("분")))
        .when(minutes < 1440, F.concat(F.format_number(minutes / 60, 1), F.lit("시간")))
        .otherwise(F.concat(F.format_number(minutes / 1440, 1), F.lit("일")))
    )


def parse_timestamp(text: Column) -> Column:
    """A timestamp from ISO text, epoch seconds or milliseconds, RFC 822, or day and month in four common orders; else null."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(r"^\d{9,13}$"), trimmed.cast("long"))
    epoch = F.when(number >= 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    rfc = F.regexp_replace(trimmed, r"^[A-Za-z]{3},\s*", "")
    formats = [F.try_to_timestamp(trimmed, F.lit(f)) for f in ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy", "dd-MM-yyyy")]
    return F.coalesce(epoch, F.try_to_timestamp(trimmed), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), *formats)
