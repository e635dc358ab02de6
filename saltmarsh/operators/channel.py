"""Analysis of channels: what kinds of messages they carry, how often, in what language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.classify import kind_terms
from saltmarsh.functions.text import script_shares


def message_types(messages: DataFrame, text: Column, terms: dict[str, tuple[str, ...]], other: str = "other") -> DataFrame:
    """channel, type, n: each message by the first category whose terms it has."""
    kind = F.coalesce(F.get(kind_terms(text, terms), F.lit(0)), F.lit(other))
    return messages.groupBy("channel", kind.alias("type")).agg(F.count("*").alias("n"))


def categories(messages: DataFrame, text: Column, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """category, n, channels: each message by all categories whose terms it has."""
    return messages.select("channel", F.explode(kind_terms(text, terms)).alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("channel").alias("channels"))


def counters(messages: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """dimension, value, n: several counters in one pass over the messages; array columns count each element."""

    def pairs_of(dimension: str, values: Column) -> Column:
        return F.transform(F.array_compact(values), lambda v: F.struct(F.lit(dimension).alias("dimension"), v.cast("string").alias("value")))

    pairs = F.flatten(F.array(*[pairs_of(d, c) for d, c in dimensions.items()]))
    return messages.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def top_text(counted: DataFrame, by: str, value: str, n: str, top: int) -> DataFrame:
    """by, text: the top values with their counts and whole percents (rounded down), most first."""
    order = Window.partitionBy(by).orderBy(F.desc(n), value)
    placed = counted.withColumns({"_k": F.row_number().over(order), "_all": F.sum(n).over(Window.partitionBy(by))}).where(F.col("_k") <= top)
    part = F.concat(F.col(value), F.lit(" "), F.col(n).cast("string"), F.lit(" ("), F.floor(F.col(n) * 100 / F.col("_all")).cast("string"), F.lit("%)"))
    return placed.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", part.alias("t")))), lambda x: x.t), ", ").alias("text"))


def price(text: Column) -> Column:
    """An amount as dollars without separators, null if there is none."""
    found = F.regexp_extract(text, r"(?i)(?:\$\s*(\d[\d,]*(?:\.\d+)?)|(\d[\d,]*(?:\.\d+)?)\s*(?:usd|\$))", 0)
    number = F.regexp_replace(found, "[^0-9.]", "")
    return F.when(number != "", F.concat(F.lit("$"), F.regexp_replace(number, r"\.0+$", "")))


def cadence(messages: DataFrame, at: str) -> DataFrame:
    """channel, n, first_at, last_at, active_days, mean_minutes, per_day."""
    stats = messages.groupBy("channel").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.countDistinct(F.to_date(at)).alias("active_days"))
    span = (F.unix_micros("last_at") - F.unix_micros("first_at")) / 60e6
    mean = F.when(F.col("n") > 1, F.round(span / (F.col("n") - 1), 3))
    return stats.withColumns({"mean_minutes": mean, "per_day": F.round(F.col("n") / F.col("active_days"), 4)})


def languages(messages: DataFrame, text: Column) -> DataFrame:
    """channel, dominant, listed: scripts by their share of letters; one with three quarters dominates, those with a tenth are listed."""
    names = ["ko", "latin", "ru", "zh", "ja"]
    sums = messages.withColumn("_s", script_shares(text)).groupBy("channel").agg(*[F.sum(f"_s.{k}").alias(k) for k in names])
    total = sum((F.col(k) for k in names), F.lit(0))
    share = lambda k: F.col(k) / total
    dominant = F.coalesce(*[F.when(share(k) >= 0.75, F.lit(k)) for k in names])
    listed = F.array_join(F.array_compact(F.array(*[F.when(share(k) >= 0.1, F.lit(k)) for k in names])), ",")
    return sums.select("channel", F.coalesce(dominant, F.lit("mixed")).alias("dominant"), listed.alias("listed"))


def role(stats: DataFrame, shares: dict[str, tuple[str, float]], other: str = "mixed") -> DataFrame:
    """stats with role: the first for which the share of its column in n reaches the least share."""
    out = F.lit(other)
    for name, (column, least) in reversed(list(shares.items())):
        out = F.when(F.col(column) >= least * F.col("n"), name).otherwise(out)
    return stats.withColumn("role", out)


def top_messages(messages: DataFrame, score: list[str], key: str, top: int) -> DataFrame:
    return messages.orderBy(*[F.desc(c) for c in score], key).limit(top)


def word_counts(messages: DataFrame, text: Column, stop: tuple[str, ...], top: int) -> DataFrame:
    """word, n of the top words of two characters or more that aren't stop words."""
    words = messages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z가-힣]{2,}"), 0)).alias("word"))
    return words.where(~F.col("word").isin(*stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def operators_of(posts: DataFrame, handle: str, board: Column, least: int) -> DataFrame:
    """handle, n, last_at of those with least posts or more on boards for which board holds."""
    return posts.where(board).groupBy(handle).agg(F.count("*").alias("n"), F.max("at").alias("last_at")).where(F.col("n") >= least)


def capped(rows: DataFrame, by: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows of each by in order as long as their texts fit the budget of characters."""
    so_far = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", so_far).where(F.col("_sum") <= budget).drop("_sum")
