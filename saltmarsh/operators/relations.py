"""Relations between venues: how often they are seen, who is near whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators.order import numbered


def counted(relations: DataFrame, evidence: DataFrame, posts: DataFrame, scope: Column) -> DataFrame:
    """relations with n, first_at, last_at: a relation without evidence counts once, one whose evidence is all out of scope not at all.

    evidence: relation, post. Each piece is one row, so a relation with very many is combined before its shuffle.
    """
    seen = evidence.join(posts.select(F.col("id").alias("post"), "posted_at", scope.alias("_in")), "post", "left")
    stats = seen.groupBy("relation").agg(F.count_if(F.col("_in")).alias("_n"), F.min(F.when(F.col("_in"), F.col("posted_at"))).alias("first_at"), F.max(F.when(F.col("_in"), F.col("posted_at"))).alias("last_at"))
    return relations.join(stats, relations["id"] == stats["relation"], "left").select(*relations.columns, F.coalesce("_n", F.lit(1)).alias("n"), "first_at", "last_at")


def among(relations: DataFrame, present: DataFrame) -> DataFrame:
    """Relations that count and whose ends are both in present (id)."""
    here = present.select("id")
    left = relations.where("n > 0").join(here.withColumnRenamed("id", "n_from"), "n_from", "left_semi")
    return left.join(here.withColumnRenamed("id", "n_to"), "n_to", "left_semi").select(*relations.columns)


def without_estimated(relations: DataFrame, shown: bool) -> DataFrame:
    return relations if shown else relations.where("confidence <> 'estimated'")


def kind_mix(relations: DataFrame) -> DataFrame:
    return relations.where("n > 0").groupBy("kind").agg(F.count("*").alias("relations"), F.sum("n").alias("n"))


def _ends(relations: DataFrame) -> DataFrame:
    """node, partner, n: each relation from both ends."""
    return relations.where("n > 0").select(F.explode(F.array(F.struct(F.col("n_from").alias("node"), F.col("n_to").alias("partner")), F.struct(F.col("n_to").alias("node"), F.col("n_from").alias("partner")))).alias("e"), "n").select("e.node", "e.partner", "n")


def weights(relations: DataFrame) -> DataFrame:
    """node, weight, partners."""
    return _ends(relations).groupBy("node").agg(F.sum("n").alias("weight"), F.countDistinct("partner").alias("partners"))


def connected_islands(relations: DataFrame, places: DataFrame) -> DataFrame:
    """node, islands: how many islands a node's partners lie on."""
    of = places.select(F.col("id").alias("partner"), "island")
    return _ends(relations).join(of, "partner").groupBy("node").agg(F.countDistinct("island").alias("islands"))


def island_pairs(relations: DataFrame, places: DataFrame) -> DataFrame:
    """island_from, island_to, pairs, n, top_kind, last_at; the top kind is the one with most, the first by name on ties."""
    a = places.select(F.col("id").alias("n_from"), F.col("island").alias("island_from"))
    b = places.select(F.col("id").alias("n_to"), F.col("island").alias("island_to"))
    kinds = relations.where("n > 0").join(a, "n_from").join(b, "n_to").groupBy("island_from", "island_to", "kind").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"), F.max("last_at").alias("last_at"))
    return kinds.groupBy("island_from", "island_to").agg(
        F.sum("pairs").alias("pairs"), F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "kind")).getField("kind").alias("top_kind"), F.max("last_at").alias("last_at")
    ).withColumnRenamed("total", "n")


def with_activity(relations: DataFrame, posts: DataFrame) -> DataFrame:
    """n_from, n_to, declared, active: relations that are declared, and those that actors' posts on a venue show."""
    shown = posts.where("actor IS NOT NULL AND actor <> territory").groupBy(F.col("actor").alias("n_from"), F.col("territory").alias("n_to")).agg(F.count("*").alias("active"))
    declared = relations.groupBy("n_from", "n_to").agg(F.count("*").alias("declared"))
    return declared.join(shown, ["n_from", "n_to"], "full_outer").select("n_from", "n_to", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("active", F.lit(0)).alias("active"))


def history(relations: DataFrame) -> DataFrame:
    """Relations with their place in time: first seen first, unknown ones last by count."""
    return numbered(relations.where("n > 0"), F.asc_nulls_last("first_at"), F.desc("n"), F.asc("id")).withColumn("place", F.col("place").cast("int"))


def hops(relations: DataFrame, center: int, cap: int = 16) -> DataFrame:
    """node, hop, n, via: nodes next to center by summed count, and up to cap nodes next to those.

    Two joins with the nodes of the hop before. via is the node of the first hop that a node of the second is linked to most.
    """
    ends = _ends(relations).groupBy("node", "partner").agg(F.sum("n").alias("n"))
    first = ends.where(F.col("node") == center).select(F.col("partner").alias("node"), F.lit(1).alias("hop"), "n", F.lit(None).cast("long").alias("via"))
    order = first.select(F.col("node").alias("mid"), F.col("n").alias("of_mid"))
    second = ends.join(order, ends["node"] == order["mid"]).where(F.col("partner") != center).select(F.col("partner").alias("node"), "n", "mid", "of_mid").join(first.select("node"), "node", "left_anti")
    best = second.groupBy("node").agg(F.sum("n").alias("total"), F.max_by("mid", F.struct("n", "of_mid", (-F.col("mid")).alias("r"))).alias("via"))
    top = best.orderBy(F.desc("total"), "node").limit(cap).select("node", F.lit(2).alias("hop"), F.col("total").alias("n"), "via")
    return first.unionByName(top)


def centers(relations: DataFrame, top: int = 6) -> DataFrame:
    """The nodes with most weight: node, weight, place."""
    return weights(relations).orderBy(F.desc("weight"), "node").limit(top).select("node", "weight")


def linked(pairs: DataFrame) -> DataFrame:
    """a, b of pairs in both directions, each once."""
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
