"""Statistics of collected claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.operators.order import numbered
from saltmarsh.functions.times import month_label

#: Label of rows without a value (fixed value).
BLANK = "(미상)"


def label(column: Column) -> Column:
    """column, or the blank label for null and white space."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(BLANK))


def scoped(items: DataFrame, source: str = "all", country: str = "all") -> DataFrame:
    """Rows of a source and a country; "all" takes any."""
    for name, value in (("source", source), ("country", country)):
        if value != "all":
            items = items.where(F.col(name) == value)
    return items


def between_days(items: DataFrame, day: Column, since: str | None, until: str | None) -> DataFrame:
    """Rows whose day lies in the range, ends included; rows without a day only if there is no range."""
    if since:
        items = items.where(day >= F.lit(since).cast("date"))
    if until:
        items = items.where(day <= F.lit(until).cast("date"))
    return items


def counts_by_source(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"))


def by_month(items: DataFrame, day: Column) -> DataFrame:
    return items.groupBy(month_label(day).alias("month")).agg(F.count("*").alias("n"))


def ranked(items: DataFrame, column: Column) -> DataFrame:
    """label, n, place: by count, the blank label last among equals, then by name."""
    counted = items.groupBy(label(column).alias("label")).agg(F.count("*").alias("n"))
    return numbered(counted, *_by_count()).withColumn("place", F.col("place").cast("int"))


def _by_count() -> list[Column]:
    return [F.desc("n"), (F.col("label") == BLANK).asc(), F.asc("label")]


def top_with_others(items: DataFrame, column: Column, top: int, others: str = "others") -> DataFrame:
    """The top labels, and one row for the others with how many they are; place 0 for none."""
    counted = items.groupBy(label(column).alias("label")).agg(F.count("*").alias("n"))
    first = counted.orderBy(*_by_count()).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*_by_count())))  # top rows
    first = first.select("label", "place", "n", F.lit(1).cast("long").alias("groups"))
    rest = counted.join(F.broadcast(first.select("label")), "label", "left_anti").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).where("groups > 0")
    return first.unionByName(rest.select(F.lit(others).alias("label"), F.lit(top + 1).alias("place"), "n", "groups"))


def distinct_values(items: DataFrame, column: Column) -> DataFrame:
    """One row: how many values column has, blanks aside. Exact."""
    return items.agg(F.countDistinct(F.nullif(F.trim(column), F.lit(""))).alias("n"))


def json_counts(items: DataFrame, raw: str, field: str) -> DataFrame:
    """Counts of a field of JSON text; malformed text and missing fields are blank."""
    return items.groupBy(label(F.get_json_object(raw, f"$['{field}']")).alias("label")).agg(F.count("*").alias("n"))


def size_split(items: DataFrame, column: Column) -> DataFrame:
    """Three rows: texts with a value, with dashes only, and blank ones."""
    bare = F.coalesce(F.trim(column), F.lit(""))
    kind = F.when(bare == "", "blank").when(bare.rlike(r"^[-–—]+$"), "dash").otherwise("value")
    counted = items.agg(*[F.count_if(kind == k).alias(k) for k in ("value", "dash", "blank")])
    return counted.selectExpr("stack(3, 'value', value, 'dash', dash, 'blank', blank) AS (kind, n)")


def discovery_lag(items: DataFrame, posted: Column, found: Column) -> DataFrame:
    """n, median_days, max_days from posting to finding, over rows that have both times; days with one decimal."""
    days = F.round((F.unix_timestamp(found) - F.unix_timestamp(posted)) / 86400, 1)
    return items.where(posted.isNotNull() & found.isNotNull()).agg(F.count("*").alias("n"), F.round(F.median(days), 4).alias("median_days"), F.max(days).alias("max_days"))


def denominator(items: DataFrame, columns: list[str], in_period: Column) -> DataFrame:
    """One row: all rows, rows in the period, and for each column how many rows have it filled."""
    filled = [F.count_if(F.trim(F.col(c).cast("string")) != "").alias(f"has_{c}") for c in columns]
    return items.agg(F.count("*").alias("n"), F.count_if(in_period).alias("n_period"), *filled)


def hide_unless(items: DataFrame, column: str, source: str, only: str) -> DataFrame:
    """items with column blanked, unless the statistics are of the source in which it may be shown."""
    return items if source == only else items.withColumn(column, F.lit(""))


#: Verdicts that count as confirmed, and the check that they need (fixed values).
CONFIRMED_VERDICTS = ("확인됨", "신뢰성 높음")
NEEDED_CHECK = "샘플 확인"
#: Reviews that take a claim out (fixed values).
REJECTED_REVIEWS = ("미검토", "사건 X")


def review_gate(collected: DataFrame, review: Column) -> DataFrame:
    """Claims that a review doesn't take out; a blank review accepts."""
    return collected.where(~F.coalesce(F.trim(review), F.lit("")).isin(*REJECTED_REVIEWS))


def funnel(items: DataFrame, collected: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: n_items, n_collected, n_verified, n_confirmed, n_outside.

    collected: case, review. verified: case, verdict, checks (array). Verifications of cases that aren't collected
    count as outside.
    """
    cases = review_gate(collected, F.col("review")).select("case").distinct()
    marked = verified.join(cases.withColumn("inside", F.lit(True)), "case", "left")
    inside = F.coalesce("inside", F.lit(False))
    confirmed = F.col("verdict").isin(*CONFIRMED_VERDICTS) & F.array_contains("checks", NEEDED_CHECK)
    tested = marked.agg(
        F.count_if(inside).alias("n_verified"), F.count_if(inside & confirmed).alias("n_confirmed"), F.count_if(~inside).alias("n_outside")
    ).withColumn("one", F.lit(1))
    total = items.agg(F.count("*").alias("n_items")).withColumn("one", F.lit(1))
    return total.join(cases.agg(F.count("*").alias("n_collected")).withColumn("one", F.lit(1)), "one").join(tested, "one").drop("one")


def verdict_histogram(collected: DataFrame, verified: DataFrame) -> DataFrame:
    """verdict, inside, n: verdicts of collected cases and of others."""
    cases = review_gate(collected, F.col("review")).select("case").distinct()
    marked = verified.join(cases.withColumn("inside", F.lit(True)), "case", "left")
    return marked.groupBy(label(F.col("verdict")).alias("verdict"), F.coalesce("inside", F.lit(False)).alias("inside")).agg(F.count("*").alias("n"))
