"""Claimed sizes: counts in Korean and other units, bytes, and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades (fixed values): rows and bytes from which a claim is large or medium.
LARGE_ROWS, MEDIUM_ROWS = 1_000_000, 100_000
LARGE_BYTES, MEDIUM_BYTES = 100 * 1024**3, 10 * 1024**3

COUNT = r"(?i)(\d[\d, ]*(?:\.\d+)?)\s*([km])?\s*(?:rows?|records?|lines?|users?|건|명|행|개)"
SHORT = r"(?i)(\d+(?:\.\d+)?)\s*([km])\b(?!b)"
KOREAN = r"(\d[\d,.]*)\s*(억|천만|백만|십만|만)"
BYTES = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*([kmgt])i?b\b"


def _most(text: Column, pattern: str, unit: dict[str, float]) -> Column:
    """The largest number that pattern finds in text, times its unit."""
    numbers = F.regexp_extract_all(text, F.lit(pattern), 1)
    units = F.regexp_extract_all(text, F.lit(pattern), 2)
    factors = F.create_map(*[x for k, v in unit.items() for x in (F.lit(k), F.lit(float(v)))])
    value = lambda n, u: F.regexp_replace(n, "[, ]", "").try_cast("double") * F.coalesce(F.element_at(factors, F.lower(u)), F.lit(1.0))
    return F.array_max(F.zip_with(numbers, units, value))


def rows_claimed(text: Column) -> Column:
    """The largest count of rows in text, null without one."""
    short = {"": 1, "k": 1e3, "m": 1e6}
    korean = {"만": 1e4, "십만": 1e5, "백만": 1e6, "천만": 1e7, "억": 1e8}
    clean = F.coalesce(text, F.lit(""))
    return F.greatest(_most(clean, COUNT, short), _most(clean, SHORT, short), _korean_total(clean), _most(clean, KOREAN, korean))


def _korean_total(text: Column) -> Column:
    """Figures such as 1억 2천만: the parts that follow each other add up."""
    whole = F.regexp_extract(text, r"(\d[\d,.]*)\s*억\s*(\d[\d,.]*)\s*(천만|백만|십만|만)", 1).try_cast("double") * 1e8
    part = F.regexp_extract(text, r"(\d[\d,.]*)\s*억\s*(\d[\d,.]*)\s*(천만|백만|십만|만)", 2).try_cast("double")
    unit = F.regexp_extract(text, r"(\d[\d,.]*)\s*억\s*(\d[\d,.]*)\s*(천만|백만|십만|만)", 3)
    factor = F.when(unit == "천만", 1e7).when(unit == "백만", 1e6).when(unit == "십만", 1e5).otherwise(1e4)
    return whole + part * factor


def bytes_claimed(text: Column) -> Column:
    """The largest number of bytes in text, null without one."""
    return _most(F.coalesce(text, F.lit("")), BYTES, {"k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4})


def grade(text: Column) -> Column:
    """large, medium, small or unknown, by the larger of both measures."""
    rows, size = F.coalesce(rows_claimed(text), F.lit(0.0)), F.coalesce(bytes_claimed(text), F.lit(0.0))
    return (
        F.when((rows >= LARGE_ROWS) | (size >= LARGE_BYTES), "large")
        .when((rows >= MEDIUM_ROWS) | (size >= MEDIUM_BYTES), "medium")
        .when((rows > 0) | (size > 0), "small")
        .otherwise("unknown")
    )


def display(text: Column) -> Column:
    """The claim as a number and a unit: 억, 만 or 건 for the most rows (files are none), else the first figure of bytes; null for none."""
    rows = rows_claimed(F.regexp_replace(text, r"\d[\d, ]*\s*개", " "))
    plain = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    of_rows = F.when(rows >= 1e8, F.concat(plain(F.round(rows / 1e8, 2)), F.lit("억"))).when(rows >= 1e4, F.concat(plain(F.round(rows / 1e4, 2)), F.lit("만"))).when(rows > 0, F.concat(F.round(rows).cast("long").cast("string"), F.lit("건")))
    amount, unit = F.regexp_extract(text, BYTES, 1), F.upper(F.regexp_extract(text, BYTES, 2))
    return F.coalesce(of_rows, F.when(amount != "", F.concat(F.regexp_replace(amount, ",", ""), unit, F.lit("B"))))


def monthly_total(text: Column) -> Column:
    """A claim of a monthly mean over some days, as the count of those days; null if the text is no such claim."""
    pattern = r"피해\s*월평균\s*([\d,]+(?:\.\d+)?)\s*건\s*\(\s*최근\s*(\d+)\s*일\s*\)"
    mean = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    days = F.regexp_extract(text, pattern, 2).try_cast("double")
    total = F.round(mean * days / 30, 1)
    return F.when(total > 0, total)
