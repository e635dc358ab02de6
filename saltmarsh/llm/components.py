"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.shared import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node goes to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    moved = both.where(F.col("other") > F.col("node")).join(least, "node")
    return moved.select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where(F.col("low") != F.col("least")).select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component for each node of links (src, dst: long); component is the smallest node reachable.

    Each round is two joins on the nodes. Minima are combined before their shuffle, and a node with very
    many links is split by Spark's handling of skewed joins. Rounds grow with the logarithm of the longest chain.
    The driver sees a count and a checksum. Links with a null end or to the node itself are dropped;
    an empty table gives an empty result.
    """
    now = links.where("src != dst").select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct()
    now, before = written(now, "links"), None
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
