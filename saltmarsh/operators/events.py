"""Lists of events: months in order, events of relations, recent figures, and when relations are first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions.events import newest_first
from saltmarsh.operators.order import numbered


def by_month(events: DataFrame, written: str, tie: str) -> DataFrame:
    """events with place (newest first), month as written, its place in the month and the month's number of events.

    A month's events stand next to each other, as the order begins with the text; so its first place tells their places
    in it, and no month's events meet in one task. Events without a time are a month of their own, null. Months are as many
    as texts begin differently, so nothing is broadcast on purpose; a large month is for adaptive execution to split.
    """
    placed = numbered(events, *newest_first(F.col(written), F.col(tie))).withColumn("month", F.substring(written, 1, 7))
    months = placed.groupBy("month").agg(F.min("place").alias("_first"), F.count("*").alias("in_month"))
    months = months.withColumnRenamed("month", "_month")
    met = placed.join(months, F.col("month").eqNullSafe(F.col("_month")))
    return met.withColumn("place_in_month", F.col("place") - F.col("_first") + 1).drop("_first", "_month")


def touching(relations: DataFrame, events: DataFrame) -> DataFrame:
    """relation, event, each pair once: events among a relation's evidence, and for an activity those of its actor in its territory.

    relations: relation, kind, from, to, evidence (array). events: event, actor, territory. Both parts are joins on keys.
    """
    shown = relations.select("relation", F.explode("evidence").alias("event")).join(events.select("event"), "event").select("relation", "event")
    active = relations.where("kind = 'activity'").select("relation", F.col("from").alias("actor"), F.col("to").alias("territory"))
    return shown.unionByName(active.join(events, ["actor", "territory"]).select("relation", "event")).distinct()


def recent_kpi(rows: DataFrame, keys: list[str], recent: str, before: str) -> DataFrame:
    """count and trend of keys: the sum of recent, and its difference to before; null where there was none before."""
    total, prior = F.coalesce(F.sum(recent), F.lit(0)), F.coalesce(F.sum(before), F.lit(0))
    return rows.groupBy(*keys).agg(total.alias("count"), F.when(prior != 0, total - prior).alias("trend"))


def first_quarters(relations: DataFrame, quarter: str, current: Column) -> DataFrame:
    """center, first_quarter: the first quarter other than the current one in which a relation (from, to) touches the center."""
    ends = relations.where(F.col(quarter) != current).select(quarter, F.explode(F.array_distinct(F.array("from", "to"))).alias("center"))
    return ends.groupBy("center").agg(F.min(quarter).alias("first_quarter"))
