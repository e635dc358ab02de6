"""Scores of venues from the posts they carry, and how a map's cells are shared out by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saltmarsh.functions.times import quarter_end

#: Weights of verdicts and sizes, and scoring constants (fixed values).
TRUST = {"confirmed": 1.0, "high": 1.0, "unverified": 0.8, "unknown": 0.7, "low": 0.4, "false": 0.0}
SIZE = {"large": 1.5, "medium": 1.2, "small": 1.0, "unknown": 1.0}
BASE, ALPHA, CELLS = 20, 0.6, 800
FORUM, ACTOR = 0, 3


def _weight(column: str, weights: dict[str, float]) -> Column:
    found = F.lit(None).cast("decimal(10,6)")
    for name, value in weights.items():
        found = F.when(F.col(column) == name, F.lit(str(value)).cast("decimal(10,6)")).otherwise(found)
    return found


def event_score(trust: dict[str, float] = TRUST, size: dict[str, float] = SIZE) -> Column:
    """Trust times size of a post, with six decimals; decimals keep sums exact in any order."""
    return F.round(_weight("verdict", trust) * _weight("size", size), 6).cast("decimal(18,6)")


def in_scope(at: Column) -> Column:
    """Posts that count at a moment: not excluded, not false, posted by then."""
    return ~F.col("excluded") & (F.col("verdict") != "false") & (F.col("posted_at") <= at)


def in_window(at: Column, from_days: int, to_days: int = 0) -> Column:
    """posted_at after from_days before at, and up to to_days before it."""
    seconds = F.unix_micros("posted_at")
    return (seconds > F.unix_micros(at) - from_days * 86_400_000_000) & (seconds <= F.unix_micros(at) - to_days * 86_400_000_000)


def touched(posts: DataFrame) -> DataFrame:
    """A row for each post and venue that it counts for: its territory, and its actor's if that is another."""
    places = F.array_distinct(F.array_compact(F.array("territory", "actor")))
    return posts.withColumn("place", F.explode(places))


def territory_totals(posts: DataFrame, at: Column) -> DataFrame:
    """place, hits, score, and counts and scores of the last 30 and 7 days and those before, first_at, last_at.

    Posts whose date is a substitute count for hits and score only.
    """
    dated = ~F.col("substituted")
    score = event_score()
    total = lambda when: F.coalesce(F.sum(F.when(when, score)), F.lit(0)).cast("double")
    return touched(posts.where(in_scope(at))).groupBy("place").agg(
        F.count("*").alias("hits"),
        F.sum(score).cast("double").alias("score"),
        F.count_if(dated & in_window(at, 30)).alias("n30"),
        F.count_if(dated & in_window(at, 60, 30)).alias("p30"),
        total(dated & in_window(at, 7)).alias("s7"),
        total(dated & in_window(at, 14, 7)).alias("ps7"),
        F.min(F.when(dated, F.col("posted_at"))).alias("first_at"),
        F.max(F.when(dated, F.col("posted_at"))).alias("last_at"),
        F.count_if(dated).alias("dated"),
    )


def present(at: Column, today: Column) -> Column:
    """Whether a venue is on the map at a day: not after the quarter in which it ended, since its start; without a start in today's quarter only."""
    ended = F.col("until").isNotNull() & (at > quarter_end(F.col("until")))
    begun = F.when(F.col("since").isNotNull(), F.col("since") <= at).otherwise(F.trunc(at, "quarter") == F.trunc(today, "quarter"))
    return ~ended & begun


def log_index(x: Column, most: Column) -> Column:
    """round(100 ln(1 + x) / ln(1 + most)); 0 if most is not positive, null for null."""
    return F.when(x.isNull(), F.lit(None)).when(F.coalesce(most, F.lit(0.0)) <= 0, 0).otherwise(F.round(100 * F.log1p(x) / F.log1p(most))).cast("long")


def computed(territories: DataFrame, posts: DataFrame, at: Column, today: Column) -> DataFrame:
    """The venues present at a moment with their metrics: id, island, hits, score, event_index, activity, weight, adjusted, rate, status, surge.

    The adjusted score is (event_index + BASE) * weight with weight = (100 + activity) / 200; it is kept as the
    whole number adjusted200 = (event_index + BASE) * (100 + activity), so that shares don't depend on the order of sums. Windows run over venues, which are
    few compared with posts; posts are only aggregated.
    """
    totals = territory_totals(posts, at).withColumnRenamed("place", "id")
    t = territories.where(present(F.to_date(at), today)).join(totals, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    island = Window.partitionBy("island")
    score = zero("score").cast("double")
    forum, raw = F.col("island") == FORUM, F.when(F.col("island") == ACTOR, zero("dated").cast("double")).otherwise(F.col("raw"))
    t = t.withColumns({"raw": raw, "score": score, "hits": zero("hits").cast("long")})
    most = {c: F.max(F.when(forum, F.col(c))).over(Window.partitionBy(forum)) for c in ("raw", "posts", "threads")}
    parts = F.array_compact(F.array(*[log_index(F.col(c), m) for c, m in most.items()]))
    mean = F.when(F.size(parts) > 0, F.round(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(parts))).otherwise(0)
    activity = F.when(forum, mean).otherwise(F.coalesce(log_index(F.col("raw"), F.max("raw").over(island)), F.lit(0))).cast("long")
    t = t.withColumns({"event_index": log_index(F.col("score"), F.max("score").over(island)), "activity": activity})
    t = t.withColumn("adjusted200", (F.col("event_index") + BASE) * (100 + F.col("activity")))
    return t.select(
        "id", "island", "name", "hits", "score", "event_index", "activity", "adjusted200",
        ((100 + F.col("activity")) / 200).alias("weight"),
        (F.col("adjusted200") / 200).alias("adjusted"),
        F.when(zero("p30") > 0, F.round((zero("n30") - zero("p30")) * 100 / zero("p30"), 4)).alias("rate"),
        F.when(zero("n30") >= 1, "활성").otherwise("관측 중").alias("status"),
        F.round(zero("s7") - zero("ps7"), 6).cast("double").alias("surge"),
        zero("n30").cast("long").alias("n30"),
        "last_at",
    )


def island_totals(metrics: DataFrame) -> DataFrame:
    """island, n, hits, score, mean_activity, adjusted."""
    return metrics.groupBy("island").agg(
        F.count("*").alias("n"), F.sum("hits").alias("hits"), F.round(F.sum(F.col("score").cast("decimal(18,6)")), 6).cast("double").alias("score"),
        F.round(F.avg("activity")).cast("long").alias("mean_activity"), F.sum("adjusted200").alias("adjusted200"),
    )


def island_targets(metrics: DataFrame, cells: int = CELLS, alpha: float = ALPHA) -> DataFrame:
    """island, target: cells shared out by the power alpha of the islands' adjusted scores; what rounding leaves goes to the largest, the first on ties."""
    sums = metrics.groupBy("island").agg((F.sum("adjusted200") / 200).alias("s"))
    all_rows = Window.partitionBy(F.lit(1))  # as many rows as there are islands
    target = F.round(cells * F.pow("s", F.lit(alpha)) / F.sum(F.pow("s", F.lit(alpha))).over(all_rows)).cast("long")
    rounded = sums.withColumn("target", target)
    left = cells - F.sum("target").over(all_rows)
    first = F.row_number().over(all_rows.orderBy(F.desc("s"), "island")) == 1
    return rounded.select("island", (F.col("target") + F.when(first, left).otherwise(0)).cast("long").alias("target"))


def cells(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """id, island, cells, share: each island's target by largest remainder with one cell at least.

    Cells over go to the largest remainders; cells short are taken from the smallest remainders that have two or more.
    """
    island = Window.partitionBy("island")
    share = F.col("adjusted200") / F.sum("adjusted200").over(island)
    t = metrics.join(F.broadcast(targets), "island").withColumn("share", share)  # a row for each island
    x = F.col("share") * F.col("target")
    t = t.withColumns({"low": F.greatest(F.floor(x), F.lit(1)).cast("long"), "rest": F.round(x - F.floor(x), 9)})
    t = t.withColumn("over", F.col("target") - F.sum("low").over(island))
    up = F.row_number().over(island.orderBy(F.desc("rest"), "id"))
    down = F.row_number().over(Window.partitionBy("island", F.col("low") >= 2).orderBy("rest", "id"))
    step = F.when((F.col("over") > 0) & (up <= F.col("over")), 1).when((F.col("over") < 0) & (F.col("low") >= 2) & (down <= -F.col("over")), -1).otherwise(0)
    return t.select("id", "island", (F.col("low") + step).cast("long").alias("cells"), F.round("share", 6).alias("share"))


def top_surges(metrics: DataFrame, limit: int) -> DataFrame:
    """The limit largest surges among venues with posts in the last 30 days."""
    return metrics.where("n30 > 0 AND surge > 0").orderBy(F.desc("surge"), "id").limit(limit).select("id", "surge")


def monthly_counts(posts: DataFrame, at: Column, months: int = 12) -> DataFrame:
    """month, n for the last months up to at, also those without posts."""
    first = F.add_months(F.trunc(F.to_date(at), "month"), 1 - months)
    spine = posts.sparkSession.range(1).select(F.explode(F.sequence(first, F.trunc(F.to_date(at), "month"), F.expr("interval 1 month"))).alias("month"))
    counted = posts.where(in_scope(at) & ~F.col("substituted")).groupBy(F.trunc(F.to_date("posted_at"), "month").alias("month")).agg(F.count("*").alias("n"))
    return spine.join(counted, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def top_shares(rows: DataFrame, name: str, n: str, top: int) -> DataFrame:
    """name, n, percent of the top rows and one row for the others."""
    counted = rows.groupBy(name).agg(F.sum(n).alias("n"))
    first = counted.orderBy(F.desc("n"), name).limit(top)
    rest = counted.join(F.broadcast(first.select(name)), name, "left_anti").agg(F.sum("n").alias("n"), F.count("*").alias("places")).where("places > 0")
    grouped = first.select(F.col(name).cast("string").alias(name), "n", F.lit(1).cast("long").alias("places")).unionByName(rest.select(F.lit("others").alias(name), "n", "places"))
    return grouped.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def activity_places(posts: DataFrame, at: Column) -> DataFrame:
    """actor, territory, n, last_at, place: where an actor posts, the most frequent first."""
    counted = posts.where(in_scope(at) & F.col("actor").isNotNull()).groupBy("actor", "territory").agg(F.count("*").alias("n"), F.max("posted_at").alias("last_at"))
    order = Window.partitionBy("actor").orderBy(F.desc("n"), F.desc("last_at"), "territory")
    return counted.withColumn("place", F.row_number().over(order))


def official(posts: DataFrame, incident: Column, at: Column) -> DataFrame:
    """territory, n, latest: incidents announced on a venue, each by its earliest post, and the latest of these."""
    first = posts.where(in_scope(at)).groupBy("territory", incident.alias("incident")).agg(F.min(F.struct("posted_at", "id")).alias("first"))
    return first.groupBy("territory").agg(F.count("*").alias("n"), F.max("first").getField("id").alias("latest"))
