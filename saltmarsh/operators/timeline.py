"""Quarterly snapshots of how many posts were known, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.times import quarter_key


def quarters(posts: DataFrame, today: Column) -> DataFrame:
    """quarter (first day), from the first post's to the last's or today's, without gaps."""
    span = posts.agg(F.min(F.to_date("posted_at")).alias("a"), F.greatest(F.max(F.to_date("posted_at")), today).alias("b"))
    return span.where("a IS NOT NULL").select(F.explode(F.sequence(F.trunc("a", "quarter"), F.trunc("b", "quarter"), F.expr("interval 3 months"))).alias("quarter"))


def snapshots(posts: DataFrame, today: Column) -> DataFrame:
    """quarter, key, n (posts so far), delta (to the same quarter last year, else null), fresh (territories with posts for the first time).

    Posts are counted by quarter, territories by the quarter of their first post; the running sums go over quarters only.
    """
    counted = posts.groupBy(F.trunc(F.to_date("posted_at"), "quarter").alias("quarter")).agg(F.count("*").alias("added"))
    firsts = posts.groupBy("territory").agg(F.min("posted_at").alias("first")).groupBy(F.trunc(F.to_date("first"), "quarter").alias("quarter")).agg(F.count("*").alias("fresh"))
    spine = quarters(posts, today).join(counted, "quarter", "left").join(firsts, "quarter", "left")
    order = Window.orderBy("quarter")  # a row for each quarter
    n = F.sum(F.coalesce("added", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = spine.select("quarter", quarter_key(F.col("quarter")).alias("key"), n.alias("n"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
    return rows.withColumn("delta", F.col("n") - F.lag("n", 4).over(order))


def year_chips(snaps: DataFrame) -> DataFrame:
    """The quarter that stands for each year: nearest to the third, the later on ties."""
    q = F.quarter("quarter")
    order = Window.partitionBy(F.year("quarter")).orderBy(F.abs(q - 3), F.desc(q))
    return snaps.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.year("quarter").alias("year"), "key", "n")


def year_steps(snaps: DataFrame) -> DataFrame:
    """key, back, ahead: the quarters a year away, clamped at the ends; null where that changes nothing."""
    order = Window.orderBy("quarter")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = F.coalesce(F.lag("key", 4).over(order), F.first("key").over(everything))
    ahead = F.coalesce(F.lead("key", 4).over(order), F.last("key").over(everything))
    return snaps.select("key", F.nullif(back, F.col("key")).alias("back"), F.nullif(ahead, F.col("key")).alias("ahead"))


def peak(snaps: DataFrame) -> DataFrame:
    """The snapshot that grew most, the first on ties: key, added."""
    order = Window.orderBy("quarter")
    grown = snaps.withColumn("added", F.col("n") - F.coalesce(F.lag("n").over(order), F.lit(0)))
    return grown.orderBy(F.desc("added"), "quarter").limit(1).select("key", "added")


def growth(posts: DataFrame, a: Column, b: Column) -> DataFrame:
    """territory, n_a, n_b, added, rate: posts known at two moments; the rate is null without posts at the first."""
    counted = posts.groupBy("territory").agg(F.count_if(F.col("posted_at") <= a).alias("n_a"), F.count_if(F.col("posted_at") <= b).alias("n_b"))
    rate = F.when(F.col("n_a") > 0, F.round((F.col("n_b") - F.col("n_a")) * 100 / F.col("n_a"), 4))
    return counted.where("n_b > 0").select("territory", "n_a", "n_b", (F.col("n_b") - F.col("n_a")).alias("added"), rate.alias("rate"))


def fresh_ids(posts: DataFrame, a: Column, b: Column) -> DataFrame:
    """Territories with posts by b and none by a."""
    return posts.groupBy("territory").agg(F.min("posted_at").alias("first")).where((F.col("first") > a) & (F.col("first") <= b)).select("territory")
