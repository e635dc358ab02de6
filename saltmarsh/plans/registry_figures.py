"""Queries: figures about the registry and the work on it."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from saltmarsh.operators import registry as figures
from saltmarsh.plans.registry import query, table

TODAY = datetime.date(2024, 1, 25)


@query("""WITH r AS (SELECT user_id AS "group", ts::DATE AS day, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type || event_id % 3 END AS industry, event_id % 4 = 0 AS korean FROM events
    WHERE ts::DATE > DATE '2024-01-25' - 10 AND ts::DATE <= DATE '2024-01-25'),
c AS (SELECT "group", industry, count(*) AS k, row_number() OVER (PARTITION BY "group" ORDER BY count(*) DESC, industry) AS place FROM r WHERE trim(industry, ' ') <> '' GROUP BY "group", industry),
t AS (SELECT "group", string_agg(industry || ' ' || k, ' · ' ORDER BY place) AS industries FROM c WHERE place <= 4 GROUP BY "group"),
n AS (SELECT "group", count(*) AS n, max(day) AS last, count(*) FILTER (korean) AS n_korean FROM r GROUP BY "group")
SELECT "group" AS user_id, n, last, n_korean, industries FROM n LEFT JOIN t USING ("group")""")
def agg_group_victims(spark, sf_dir):
    e = F.col("event_id")
    industry = F.when(e % 5 == 0, " ").otherwise(F.concat("event_type", (e % 3).cast("string")))
    return figures.group_victims(table(spark, sf_dir, "events"), "user_id", F.to_date("ts"), F.lit(TODAY), industry, e % 4 == 0, days=10)


@query("""WITH f AS (SELECT lower(c_mktsegment) AS key, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS name, count(*) AS k FROM customer GROUP BY ALL)
SELECT key, first(name ORDER BY k DESC, name) AS name, sum(k)::BIGINT AS n, count(*) AS spellings FROM f WHERE key <> '' GROUP BY key""")
def agg_common_spelling(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("name"))
    return figures.common_spelling(rows, F.lower("name"), "name")


@query("""WITH a AS (SELECT user_id, DATE '2024-01-25' - ts::DATE AS ago FROM events), c AS (SELECT user_id, count(*) FILTER (ago BETWEEN 0 AND 9) AS now, count(*) FILTER (ago BETWEEN 10 AND 19) AS before FROM a GROUP BY user_id)
SELECT *, CASE WHEN before > 0 THEN round((now - before) * 100 / before, 1) END AS rate FROM c""")
def agg_change_rate(spark, sf_dir):
    return figures.change_rate(table(spark, sf_dir, "events"), "user_id", F.to_date("ts"), F.lit(TODAY), 10)


@query("""SELECT CASE WHEN event_id % 6 = 0 OR ts IS NULL THEN 'never' WHEN DATE '2024-01-25' - ts::DATE <= 7 THEN '<=7' WHEN DATE '2024-01-25' - ts::DATE <= 30 THEN '<=30' WHEN DATE '2024-01-25' - ts::DATE <= 90 THEN '<=90' ELSE 'later' END AS bucket, count(*) AS n FROM events GROUP BY bucket""")
def agg_age_buckets(spark, sf_dir):
    return figures.age_buckets(table(spark, sf_dir, "events"), F.when(F.col("event_id") % 6 != 0, F.to_date("ts")), F.lit(TODAY))


@query("SELECT event_id, coalesce(event_type IN ('view', 'click') AND DATE '2024-01-25' - ts::DATE > 14, false) AS stale FROM events")
def flt_stale(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", figures.stale(F.to_date("ts"), F.lit(TODAY), F.col("event_type"), ("view", "click"), 14).alias("stale"))


@query("""WITH c AS (SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 6 HOUR AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id))) AS short,
    (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 1 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id))) AS long FROM events a)
SELECT event_id, short, long, short <= 2 AND long <= 5 AS allowed FROM c""")
def win_rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    found = figures.within_limits(rows, "user_id", "ts", "event_id", ((21600, 2), (86400, 5)))
    return found.select("event_id", F.col("n_21600").alias("short"), F.col("n_86400").alias("long"), "allowed")


@query("""WITH new AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey), q AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'dismissed' ELSE 'pending' END AS state, c_custkey % 5 AS hits FROM customer WHERE c_custkey % 3 = 0)
SELECT o_custkey, coalesce(state, 'pending') AS state, CASE WHEN state = 'dismissed' THEN hits ELSE coalesce(hits, 0) + coalesce(k, 0) END AS hits FROM q FULL JOIN new USING (o_custkey)""")
def store_queue_put(spark, sf_dir):
    c = F.col("c_custkey")
    queue = table(spark, sf_dir, "customer").where(c % 3 == 0).select(c.alias("o_custkey"), F.when(c % 4 == 0, "dismissed").otherwise("pending").alias("state"), (c % 5).alias("hits"))
    return figures.queue_put(queue, table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY week")
def agg_weekly(spark, sf_dir):
    return figures.weekly(table(spark, sf_dir, "events"), F.col("ts"), "value")


SAID = ("3 hours ago", "2 days ago", "Yesterday, 10:00", "05-01-24", "1 month ago", "2 weeks ago", "31-02-24", "soon", None)


@query("""SELECT doc_id, (['2024-01-25', '2024-01-23', '2024-01-24', '2024-01-05', '2023-12-25', '2024-01-11', NULL, NULL, NULL])[doc_id % 9 + 1]::DATE AS day FROM documents""")
def text_relative_day(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("doc_id") % 9).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", figures.relative_day(said, F.lit(TODAY)).alias("day"))
