"""Figures about the registry of venues and the work on it: groups' victims, spellings, ages, limits, and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_victims(claims: DataFrame, group: str, day: Column, today: Column, industry: Column, korean: Column, days: int = 180, top: int = 4) -> DataFrame:
    """group, n, last, n_korean, industries of the claims of the last days: the top industries with counts, most first, then by name."""
    recent = claims.select(F.col(group).alias("group"), day.alias("day"), F.trim(F.coalesce(industry, F.lit(""))).alias("industry"), F.coalesce(korean, F.lit(False)).alias("korean"))
    recent = recent.where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today))
    totals = recent.groupBy("group").agg(F.count("*").alias("n"), F.max("day").alias("last"), F.count_if("korean").alias("n_korean"))
    counted = recent.where("industry <> ''").groupBy("group", "industry").agg(F.count("*").alias("k"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("k"), "industry"))).where(F.col("place") <= top)
    said = F.transform(F.array_sort(F.collect_list(F.struct("place", "industry", "k"))), lambda x: F.concat(x.industry, F.lit(" "), x.k.cast("string")))
    return totals.join(first.groupBy("group").agg(F.array_join(said, " · ").alias("industries")), "group", "left").withColumnRenamed("group", group)


def common_spelling(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """key, name, n, spellings: the most common way to write each key, the first in order of equals. Blank keys are left out."""
    forms = rows.select(key.alias("key"), F.col(name).alias("name")).where("key <> ''").groupBy("key", "name").agg(F.count("*").alias("k"))
    return forms.groupBy("key").agg(F.min_by("name", F.struct(-F.col("k"), "name")).alias("name"), F.sum("k").alias("n"), F.count("*").alias("spellings"))


def change_rate(rows: DataFrame, by: str, day: Column, today: Column, days: int = 30) -> DataFrame:
    """by, now, before, rate: rows of the last days, of as many before, and the change in percent; null from nothing."""
    ago = F.datediff(today, day)
    found = rows.groupBy(by).agg(F.count_if((ago >= 0) & (ago < days)).alias("now"), F.count_if((ago >= days) & (ago < 2 * days)).alias("before"))
    return found.withColumn("rate", F.when(F.col("before") > 0, F.round((F.col("now") - F.col("before")) * 100 / F.col("before"), 1)))


def age_buckets(rows: DataFrame, seen: Column, today: Column, ends: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """bucket, n: rows by the days since seen: up to each end, later, or never."""
    age = F.datediff(today, seen)
    bucket = F.when(age.isNull(), "never")
    for end in ends:
        bucket = bucket.when(age <= end, f"<={end}")
    return rows.groupBy(bucket.otherwise("later").alias("bucket")).agg(F.count("*").alias("n"))


def stale(observed: Column, today: Column, kind: Column, kinds: tuple[str, ...], days: int) -> Column:
    """Whether an observation is too old, for the kinds that age. No date is not stale."""
    return F.coalesce(kind.isin(*kinds) & (F.datediff(today, observed) > days), F.lit(False))


def within_limits(requests: DataFrame, who: str, at: str, order: str, limits: tuple[tuple[int, int], ...]) -> DataFrame:
    """requests with n_<seconds> for each (seconds, most) of limits and allowed: requests of who in the time up to each, itself included.

    All requests count, also those turned away.
    """
    when = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.withColumn("_at", when)
    allowed = F.lit(True)
    for seconds, most in limits:
        window = Window.partitionBy(who).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
        # Of requests at the same instant only the earlier in order count.
        same = Window.partitionBy(who, "_at").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"n_{seconds}", F.count("*").over(window) - F.count("*").over(same))
        allowed = allowed & (F.col(f"n_{seconds}") <= most)
    return rows.withColumn("allowed", allowed).drop("_at")


def queue_put(queue: DataFrame, arrivals: DataFrame, key: str) -> DataFrame:
    """key, state, hits of a queue after arrivals: new keys are pending, pending ones gain hits, dismissed ones stay as they are."""
    new = arrivals.groupBy(key).agg(F.count("*").alias("_new"))
    both = queue.join(new, key, "full")
    hits = F.when(F.col("state") == "dismissed", F.col("hits")).otherwise(F.coalesce("hits", F.lit(0)) + F.coalesce("_new", F.lit(0)))
    return both.select(key, F.coalesce("state", F.lit("pending")).alias("state"), hits.alias("hits"))


def weekly(rows: DataFrame, at: Column, value: str) -> DataFrame:
    """week (its Monday), n, mean, most."""
    return rows.groupBy(F.to_date(F.date_trunc("week", at)).alias("week")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))


def relative_day(text: Column, today: Column) -> Column:
    """The day of "3 hours ago", "2 days ago", "Yesterday", "Today" or DD-MM-YY, seen today; other texts: null. Hours and minutes ago are today."""
    low = F.lower(F.trim(text))
    n = F.regexp_extract(low, r"^(\d{1,4}) (?:day|week|month|year)s? ago$", 1).try_cast("int")
    unit = F.regexp_extract(low, r"^\d{1,4} (day|week|month|year)s? ago$", 1)
    return (
        F.when(low.rlike(r"^today\b|^\d+ (second|minute|hour)s? ago$|^just now$"), today)
        .when(low.rlike(r"^yesterday\b"), F.date_sub(today, 1))
        .when(unit == "day", F.date_sub(today, n))
        .when(unit == "week", F.date_sub(today, n * 7))
        .when(unit == "month", F.add_months(today, -n))
        .when(unit == "year", F.add_months(today, -12 * n))
        .when(low.rlike(r"^\d{2}-\d{2}-\d{2}$"), F.try_to_date(low, "dd-MM-yy"))
    )
