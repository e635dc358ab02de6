"""Name search over venues and what is linked to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def needle(text: Column) -> Column:
    return F.lower(F.trim(text))


def match_rank(name: Column, aliases: Column, wanted: Column) -> Column:
    """0 for an exact match, 1 for a prefix, 2 within, else null; the best over the name and its aliases."""
    forms = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))

    def rank(form: Column) -> Column:
        low = F.lower(form)
        return F.when(low == wanted, 0).when(F.startswith(low, wanted), 1).when(F.contains(low, wanted), 2)

    return F.when(wanted != "", F.array_min(F.transform(forms, rank)))


def nearby(names: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """Suggestions for a needle that matches nothing: name, distance, count.

    The distance is the smaller of those to the name and to its beginning of the needle's length, a third of the needle's length at most.
    """
    word = wanted.strip().lower()
    limit = max(1, len(word) // 3)
    low = F.lower("name")
    distance = F.least(F.levenshtein(low, F.lit(word)), F.levenshtein(F.substring(low, 1, len(word)), F.lit(word)))
    found = names.withColumn("distance", distance).where((F.col("distance") <= limit) & F.lit(len(word) >= 2))
    return found.orderBy("distance", F.desc("count"), "name").limit(most).select("name", "distance", "count")


def associated(places: DataFrame, posts: DataFrame, relations: DataFrame, wanted: str) -> DataFrame:
    """kind, id, rank: venues whose name matches, posts on them, and relations that touch them, with the best rank of their ends."""
    seeds = places.withColumn("rank", match_rank(F.col("name"), F.lit(None).cast("array<string>"), F.lit(wanted.strip().lower()))).where("rank IS NOT NULL").select("id", "rank")
    of_post = posts.select(F.col("id").alias("post"), F.explode(F.array_compact(F.array("territory", "actor"))).alias("id")).join(seeds, "id").groupBy("post").agg(F.min("rank").alias("rank"))
    of_relation = relations.select(F.col("id").alias("relation"), F.explode(F.array("n_from", "n_to")).alias("id")).join(seeds, "id").groupBy("relation").agg(F.min("rank").alias("rank"))
    return (
        seeds.select(F.lit("place").alias("kind"), "id", "rank")
        .unionByName(of_post.select(F.lit("post").alias("kind"), F.col("post").alias("id"), "rank"))
        .unionByName(of_relation.select(F.lit("relation").alias("kind"), F.col("relation").alias("id"), "rank"))
    )


def recent(rows: DataFrame, key: str, at: str, by: str, most: int = 5) -> DataFrame:
    """For each by the most newest distinct keys."""
    newest = rows.groupBy(by, key).agg(F.max(at).alias(at))
    return newest.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), key))).where(F.col("place") <= most)
