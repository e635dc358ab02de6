"""Queries: states from observations, back-off and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import tracking
from saltmarsh.plans.canonical import OBSERVATIONS_SQL, observations
from saltmarsh.plans.registry import query, table

NOW = "1998-06-01 00:00:00"
OBS = f"WITH {OBSERVATIONS_SQL}"


@query(f"""{OBS} SELECT uid, arg_max(state, (observed_at, seq)) FILTER (src = 'origin') AS last_origin,
    arg_max(state, (observed_at, seq)) FILTER (src = 'agg') AS last_agg, max(observed_at) AS last_seen FROM observations GROUP BY uid""")
def track_last_state(spark, sf_dir):
    return tracking.last_states(observations(spark, sf_dir))


@query(f"""{OBS}, placed AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY observed_at DESC, seq DESC) AS back FROM observations WHERE src = 'agg')
SELECT uid, count(*) FILTER (state = '안 보임') = 2 AS gone FROM placed WHERE back <= 2 GROUP BY uid""")
def track_consecutive_miss(spark, sf_dir):
    return tracking.twice_unseen(observations(spark, sf_dir))


CLASSIFIED_SQL = f"""facts AS (
    SELECT uid, arg_max(state, (observed_at, seq)) FILTER (src = 'origin') AS last_origin,
        arg_max(expiry_est, (observed_at, seq)) FILTER (expiry_est IS NOT NULL) AS expiry,
        max(observed_at) FILTER (src = 'origin') AS origin_at
    FROM observations GROUP BY uid
), pairs AS (
    SELECT uid, count(*) FILTER (state = '안 보임') = 2 AS gone FROM (
        SELECT *, row_number() OVER (PARTITION BY uid ORDER BY observed_at DESC, seq DESC) AS back FROM observations WHERE src = 'agg'
    ) WHERE back <= 2 GROUP BY uid
), classified AS (
    SELECT uid, CASE WHEN last_origin = '공개됨' THEN '공개됨' WHEN last_origin = '사라짐' THEN '사라짐' WHEN gone THEN '사라짐'
        WHEN last_origin = '연장' THEN '연장'
        WHEN last_origin = '불명' THEN CASE WHEN expiry IS NULL OR expiry < TIMESTAMP '{NOW}' THEN '불명' ELSE '' END
        WHEN expiry < TIMESTAMP '{NOW}' AND (origin_at IS NULL OR origin_at < expiry) THEN '불명' ELSE '' END AS state
    FROM facts LEFT JOIN pairs USING (uid)
)"""


@query(f"{OBS}, {CLASSIFIED_SQL} SELECT uid, state FROM classified")
def track_classify(spark, sf_dir):
    return tracking.classified(observations(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"{OBS}, {CLASSIFIED_SQL} SELECT state, count(*) AS n FROM classified GROUP BY state")
def track_numbers(spark, sf_dir):
    return tracking.numbers(tracking.classified(observations(spark, sf_dir), F.lit(NOW).cast("timestamp")))


@query(f"{OBS} SELECT uid, arg_max(note, (observed_at, seq)) FILTER (trim(note) <> '') AS note FROM observations GROUP BY uid")
def track_last_nonblank(spark, sf_dir):
    return tracking.last_filled(observations(spark, sf_dir), "note")


@query(f"""{OBS}, last AS (SELECT uid, max(src = 'origin') AS has_origin, arg_max(state, (observed_at, seq)) FILTER (src = 'agg') AS state FROM observations GROUP BY uid)
SELECT state, count(*) AS n FROM last WHERE NOT has_origin GROUP BY state""")
def track_aggregator_only(spark, sf_dir):
    return tracking.aggregator_only(observations(spark, sf_dir))


@query(f"""{OBS} SELECT seq, uid, CASE WHEN seq % 5 = 0 THEN 'state' END AS reason FROM observations n
WHERE seq % 10 < 6 AND NOT EXISTS (SELECT 1 FROM observations k WHERE k.seq % 4 = 0 AND k.uid = n.uid AND k.observed_at = n.observed_at AND k.src = n.src)
UNION ALL SELECT seq, uid, 'known' FROM observations n
WHERE seq % 10 < 6 AND EXISTS (SELECT 1 FROM observations k WHERE k.seq % 4 = 0 AND k.uid = n.uid AND k.observed_at = n.observed_at AND k.src = n.src)""")
def track_pull(spark, sf_dir):
    rows = observations(spark, sf_dir)
    new = rows.where("seq % 10 < 6").withColumn("state", F.when(F.col("seq") % 5 == 0, "?").otherwise(F.col("state")))
    return tracking.pulled(new, rows.where("seq % 4 = 0")).select("seq", "uid", "reason")


@query(f"""{OBS}, last AS (SELECT uid, arg_max(state, (observed_at, seq)) FILTER (src = 'agg') AS before, count(*) % 2 = 0 AS seen, count(*) % 7 = 0 AS human FROM observations GROUP BY uid),
moved AS (SELECT *, CASE WHEN seen THEN '게시 중' WHEN before IN ('안 보임', '사라짐') THEN '사라짐' ELSE '안 보임' END AS after FROM last)
SELECT CASE WHEN human THEN 'human' WHEN coalesce(before, '') NOT IN ('', '게시 중', '안 보임') THEN 'final' WHEN after = before THEN 'same' END AS skipped, after, count(*) AS n
FROM moved GROUP BY 1, 2""")
def track_push(spark, sf_dir):
    last = tracking.last_states(observations(spark, sf_dir)).join(observations(spark, sf_dir).groupBy("uid").agg(F.count("*").alias("k")), "uid")
    changes = tracking.push_changes(last, F.col("last_agg"), F.col("k") % 2 == 0, F.col("k") % 7 == 0)
    return changes.groupBy("skipped", "after").agg(F.count("*").alias("n"))


TRIES = "tries AS (SELECT user_id AS place, ts AS tried, event_type IN ('error', 'signup', 'view') AS failed FROM events)"
STREAKS = f"""WITH {TRIES}, good AS (SELECT place, max(tried) AS good_at FROM tries WHERE NOT failed GROUP BY place),
streaks AS (SELECT t.place, count(*) FILTER (failed AND (good_at IS NULL OR tried > good_at)) AS streak, max(tried) AS last_at FROM tries t LEFT JOIN good USING (place) GROUP BY t.place)"""


def tries(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("place"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").isin("error", "signup", "view").alias("failed"), "value")


@query(f"{STREAKS} SELECT place, streak, ([0, 0, 1, 3, 7, 14])[least(streak, 5)::INT + 1] AS rest_days, last_at FROM streaks")
def reg_backoff(spark, sf_dir):
    return tracking.failure_streaks(tries(spark, sf_dir), "place", "at", "failed")


@query(f"""{STREAKS}, rests AS (SELECT *, ([0, 0, 1, 3, 7, 14])[least(streak, 5)::INT + 1] AS rest_days FROM streaks)
SELECT place, last_at + rest_days * INTERVAL 1 DAY > TIMESTAMP '2024-01-31 00:00:00' AS resting FROM rests""")
def reg_due(spark, sf_dir):
    rest = tracking.failure_streaks(tries(spark, sf_dir), "place", "at", "failed")
    until = F.timestamp_seconds(F.unix_timestamp("last_at") + F.col("rest_days") * 86400)
    return rest.select("place", (until > F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("resting"))


@query(f"{STREAKS} SELECT place, CASE WHEN streak = 0 THEN 30.0 ELSE least(60.0, 5 * power(2.0, streak - 1)) END::DOUBLE AS minutes FROM streaks")
def reg_retry(spark, sf_dir):
    rest = tracking.failure_streaks(tries(spark, sf_dir), "place", "at", "failed")
    return rest.select("place", tracking.retry_minutes(F.col("streak"), F.lit(30.0)).alias("minutes"))


@query("SELECT event_type, count(*) AS n, median(value) AS median_value, max(value) AS max_value FROM events GROUP BY event_type")
def reg_latency(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.median("value").alias("median_value"), F.max("value").alias("max_value"))
