"""Queries: streams of the events that are there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.plans.registry import query, table
from saltmarsh.streaming import monitor, schedule


def events(spark, sf_dir):
    rows = monitor.new_rows(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


@query("SELECT event_id, user_id FROM events")
def stream_once_each(spark, sf_dir):
    twice = events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return monitor.caught_up(monitor.once_each(twice, "ts", ["event_id"], "3650 days").select("event_id", "user_id"), "once-each")


@query("SELECT user_id, max(event_id) AS high FROM events GROUP BY user_id")
def stream_high_water(spark, sf_dir):
    updates = monitor.caught_up(monitor.high_water(events(spark, sf_dir), "user_id", F.col("event_id")), "high-water", "update")
    return updates.groupBy("user_id").agg(F.max("high").alias("high"))


@query("""WITH seen AS (SELECT user_id, event_id, ts, coalesce(event_id % 5 = 0, false) AS seen FROM events),
runs AS (SELECT *, count(*) FILTER (seen) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM seen),
placed AS (SELECT *, count(*) FILTER (NOT seen) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS missed FROM runs)
SELECT user_id, event_id, run > 0 AND missed < 3 AS shown, missed FROM placed""")
def stream_held_states(spark, sf_dir):
    return monitor.caught_up(monitor.held_states(events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_id") % 5 == 0), "held-states")


@query("""WITH tried AS (SELECT user_id, event_id, ts, coalesce(event_id % 4 = 0, false) AS ok FROM events),
runs AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM tried),
counted AS (SELECT user_id, event_id, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM runs)
SELECT user_id, event_id, failures, ([0, 0, 1, 3, 7, 14])[least(failures, 5) + 1]::BIGINT AS rest_days FROM counted""")
def stream_rests(spark, sf_dir):
    return monitor.caught_up(schedule.rests(events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_id") % 4 == 0), "rests")


@query("""SELECT CAST(day AS DATE) AS day, event_type, count(*) AS n
FROM (SELECT event_type, unnest(range(ts::DATE + INTERVAL 1 DAY, ts::DATE + INTERVAL 8 DAY, INTERVAL 1 DAY)) AS day FROM events) GROUP BY ALL""")
def stream_recent_counts(spark, sf_dir):
    updates = monitor.caught_up(schedule.recent_counts(events(spark, sf_dir), "ts", "event_type"), "recent", "update")
    return updates.groupBy("day", "event_type").agg(F.max("n").alias("n"))


@query("""WITH marked AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM runs GROUP BY user_id, run""")
def agg_visits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = schedule.visits(rows, "ts", "user_id", "12 hours")
    return found.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("""SELECT user_id, event_id, live, row_number() OVER (PARTITION BY user_id ORDER BY live, event_id) AS turn
FROM (SELECT user_id, event_id, NOT (event_id % 3 <> 0) AS live FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0)""")
def track_catch_up(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    found = schedule.catch_up_order(rows.where("event_id % 3 <> 0"), rows.where("event_id % 2 = 0"), "user_id", "event_id")
    return found.withColumn("turn", F.col("turn").cast("long"))


@query("SELECT event_id FROM events WHERE event_id % 9 = 0 OR ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 14 DAY")
def store_fresh(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("seen"))
    return schedule.fresh(rows, "seen", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 14).select("event_id")


@query("SELECT 'nation' AS batch, n_nationkey::BIGINT AS id FROM nation")
def flt_resync_surge(spark, sf_dir):
    """Batches of 25 rows, of thousands, and of a first run: only the first is announced."""
    rows = [("nation", "n_nationkey", False), ("part", "p_partkey", False), ("region", "r_regionkey", True)]
    batches = [(table(spark, sf_dir, name).select(F.lit(name).alias("batch"), F.col(key).cast("long").alias("id")), first) for name, key, first in rows]
    parts = [schedule.announced(batch, first) for batch, first in batches]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
