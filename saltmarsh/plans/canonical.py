"""The test tables as the library's own tables: items, observations, posts, territories, relations.

Each view is a projection of one table, as Spark columns and as the SQL for the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.plans.registry import table

ISLANDS = ("FORUM", "RANSOMWARE", "TELEGRAM", "ACTOR")
#: Queries about a moment look back from here.
AS_OF = "2024-01-25 00:00:00"

ITEMS_SQL = """items AS (
    SELECT doc_id AS uid, source, 'v' || doc_id % 13 AS venue,
        CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'actor ' || doc_id % 29 END AS actor,
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Org ' || doc_id % 41 END AS target_org,
        CASE WHEN doc_id % 31 = 0 THEN NULL ELSE TIMESTAMP '2026-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR END AS posted_at,
        upper(lang) AS country,
        CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '---' WHEN 3 THEN '12 GB' ELSE n_chars || ' rows' END AS claimed_size,
        'sector ' || doc_id % 6 AS industry,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2026-01-01 00:00:00' + (doc_id + doc_id % 97) * INTERVAL 1 HOUR END AS found_at,
        doc_id % 3 = 0 AS is_new, doc_id, text, n_chars
    FROM documents
)"""


def _hours(n) -> F.Column:
    return F.timestamp_seconds(F.lit(1767225600) + n * 3600)  # from the start of 2026


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected claims, one a row."""
    d = F.col("doc_id")
    kind = d % 5
    size = F.when(kind == 0, "").when(kind == 1, "-").when(kind == 2, "---").when(kind == 3, "12 GB").otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(" rows")))
    industry = F.concat(F.lit("sector "), (d % 6).cast("string"))
    return table(spark, sf_dir, "documents").select(
        d.alias("uid"),
        "source",
        F.concat(F.lit("v"), (d % 13).cast("string")).alias("venue"),
        F.when(d % 7 == 0, "").otherwise(F.concat(F.lit("actor "), (d % 29).cast("string"))).alias("actor"),
        F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("Org "), (d % 41).cast("string"))).alias("target_org"),
        F.when(d % 31 != 0, _hours(d)).alias("posted_at"),
        F.upper("lang").alias("country"),
        size.alias("claimed_size"),
        F.to_json(F.struct(industry.alias("industry"))).alias("raw"),
        F.when(d % 4 != 0, _hours(d + d % 97)).alias("found_at"),
        (d % 3 == 0).alias("is_new"),
        "doc_id",
        "text",
        "n_chars",
    )


OBSERVATIONS_SQL = """observations AS (
    SELECT o_custkey AS uid, o_orderdate + o_orderkey % 1440 * INTERVAL 1 MINUTE AS observed_at, o_orderkey AS seq,
        CASE WHEN o_orderkey % 3 = 0 THEN 'origin' ELSE 'agg' END AS src,
        CASE WHEN o_orderkey % 3 = 0 THEN
                CASE o_orderkey % 5 WHEN 0 THEN '공개됨' WHEN 1 THEN '연장' WHEN 2 THEN '불명' WHEN 3 THEN '게시 중' ELSE '사라짐' END
            WHEN o_orderstatus = 'O' THEN '게시 중' ELSE '안 보임' END AS state,
        CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS expiry_est,
        CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'note ' || o_orderkey % 10 END AS note
    FROM orders
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was seen of each claim, and when: rows are only ever added."""
    k = F.col("o_orderkey")
    own = F.when(k % 5 == 0, "공개됨").when(k % 5 == 1, "연장").when(k % 5 == 2, "불명").when(k % 5 == 3, "게시 중").otherwise("사라짐")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("uid"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + k % 1440 * 60).alias("observed_at"),
        k.alias("seq"),
        F.when(k % 3 == 0, "origin").otherwise("agg").alias("src"),
        F.when(k % 3 == 0, own).when(F.col("o_orderstatus") == "O", "게시 중").otherwise("안 보임").alias("state"),
        F.when(k % 4 == 0, F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 30 * 86400)).alias("expiry_est"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("note "), (k % 10).cast("string"))).alias("note"),
    )


POSTS_SQL = """posts AS (
    SELECT event_id AS id, user_id AS territory,
        CASE WHEN event_id % 3 = 0 THEN (user_id * 7 + 3) % 37 * 4 + 3 END AS actor,
        ts AS posted_at,
        CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'purchase' THEN 'high' WHEN 'view' THEN 'unverified' WHEN 'signup' THEN 'low' ELSE 'false' END AS verdict,
        CASE WHEN value >= 60 THEN 'large' WHEN value >= 20 THEN 'medium' WHEN value >= 5 THEN 'small' ELSE 'unknown' END AS size,
        event_id % 50 = 0 AS excluded, event_id % 11 = 0 AS substituted, event_id % 7 = 0 AS repost
    FROM events
)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that claim a leak, with their verdicts."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    kind = F.col("event_type")
    verdict = F.when(kind == "click", "confirmed").when(kind == "purchase", "high").when(kind == "view", "unverified").when(kind == "signup", "low").otherwise("false")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        u.alias("territory"),
        F.when(e % 3 == 0, (u * 7 + 3) % 37 * 4 + 3).alias("actor"),
        F.col("ts").cast("timestamp").alias("posted_at"),
        verdict.alias("verdict"),
        F.when(v >= 60, "large").when(v >= 20, "medium").when(v >= 5, "small").otherwise("unknown").alias("size"),
        (e % 50 == 0).alias("excluded"),
        (e % 11 == 0).alias("substituted"),
        (e % 7 == 0).alias("repost"),
    )


TERRITORIES_SQL = """territories AS (
    SELECT c_custkey AS id, c_custkey % 4 AS island, c_name AS name,
        greatest(c_acctbal, 0)::DOUBLE AS raw,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE floor(abs(c_acctbal) / 7) END::DOUBLE AS posts,
        CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE floor(abs(c_acctbal) / 31) END::DOUBLE AS threads,
        CASE WHEN c_custkey % 6 <> 0 THEN DATE '2023-11-01' + (c_custkey % 80)::INT END AS since,
        CASE WHEN c_custkey % 17 = 0 THEN DATE '2023-09-01' + (c_custkey % 200)::INT END AS until
    FROM customer
)"""


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues, on four islands."""
    c, money = F.col("c_custkey"), F.col("c_acctbal")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), n.cast("int"))
    return table(spark, sf_dir, "customer").select(
        c.alias("id"),
        (c % 4).alias("island"),
        F.col("c_name").alias("name"),
        F.greatest(money, F.lit(0.0)).alias("raw"),
        F.when(c % 5 != 0, F.floor(F.abs(money) / 7).cast("double")).alias("posts"),
        F.when(c % 3 != 0, F.floor(F.abs(money) / 31).cast("double")).alias("threads"),
        F.when(c % 6 != 0, day("2023-11-01", c % 80)).alias("since"),
        F.when(c % 17 == 0, day("2023-09-01", c % 200)).alias("until"),
    )


RELATIONS_SQL = """relations AS (
    SELECT n_from * 10000 + n_to AS id, n_from, n_to,
        CASE (n_from + n_to) % 4 WHEN 0 THEN 'moved' WHEN 1 THEN 'ally' WHEN 2 THEN 'resale' ELSE 'same' END AS kind,
        CASE WHEN (n_from + n_to) % 3 = 0 THEN 'estimated' ELSE 'confirmed' END AS confidence
    FROM (SELECT DISTINCT user_id AS n_from, (user_id * 5 + event_id % 4 * 11 + 1) % 1500 AS n_to FROM events)
    WHERE n_from <> n_to
), evidence AS (
    SELECT DISTINCT r.id AS relation, e.event_id AS post
    FROM relations r JOIN events e ON e.user_id = r.n_from AND (e.user_id * 5 + e.event_id % 4 * 11 + 1) % 1500 = r.n_to
    WHERE r.id % 5 <> 0
)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links between venues: id, n_from, n_to, kind, confidence."""
    e, u = F.col("event_id"), F.col("user_id")
    pairs = table(spark, sf_dir, "events").select(u.alias("n_from"), ((u * 5 + e % 4 * 11 + 1) % 1500).alias("n_to")).distinct()
    both = F.col("n_from") + F.col("n_to")
    return pairs.where("n_from <> n_to").select(
        (F.col("n_from") * 10000 + F.col("n_to")).alias("id"),
        "n_from",
        "n_to",
        F.when(both % 4 == 0, "moved").when(both % 4 == 1, "ally").when(both % 4 == 2, "resale").otherwise("same").alias("kind"),
        F.when(both % 3 == 0, "estimated").otherwise("confirmed").alias("confidence"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that show a relation: relation, post. A relation may have none."""
    e, u = F.col("event_id"), F.col("user_id")
    links = table(spark, sf_dir, "events").select((u * 10000 + (u * 5 + e % 4 * 11 + 1) % 1500).alias("relation"), e.alias("post"), u.alias("n_from"), ((u * 5 + e % 4 * 11 + 1) % 1500).alias("n_to"))
    return links.where("n_from <> n_to AND relation % 5 <> 0").select("relation", "post").distinct()
