"""Queries: the item store, and sets and differences of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import store
from saltmarsh.plans.canonical import ITEMS_SQL, items
from saltmarsh.plans.registry import query, table

WITH = f"WITH {ITEMS_SQL}"


@query(f"{WITH} SELECT uid AS doc_id, substr(sha1(concat_ws('|', lower(source), venue, '', lower(trim(actor)), lower(target_org), lower(trim(text)))), 1, 16) AS uid FROM items")
def store_uid(spark, sf_dir):
    key = store.uid(F.col("source"), F.col("venue"), F.lit(None).cast("string"), F.col("actor"), F.col("target_org"), F.col("text"))
    return items(spark, sf_dir).select(F.col("uid").alias("doc_id"), key.alias("uid"))


@query(f"{WITH} SELECT uid AS doc_id, substr(sha256(actor || chr(31) || target_org), 1, 32) AS uid FROM items")
def store_pair_uid(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("uid").alias("doc_id"), store.pair_uid(F.col("actor"), F.col("target_org")).alias("uid"))


ARRIVALS = """stored AS (
    SELECT c_custkey AS uid, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN '없음' ELSE c_mktsegment END AS kind,
        CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'body ' || c_custkey END AS body, CASE WHEN c_custkey % 5 = 0 THEN 'post' ELSE 'blurb' END AS body_kind,
        ['feed'] AS via, DATE '1995-01-01' AS first_seen, DATE '1995-01-01' AS last_seen, c_custkey % 11 = 0 AS forgotten
    FROM customer WHERE c_custkey % 10 <> 9
), arrivals AS (
    SELECT o_custkey AS uid, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'order ' || o_orderkey END AS name, CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE o_orderpriority END AS kind,
        CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'text ' || o_orderkey END AS body, CASE WHEN o_orderkey % 7 = 0 THEN 'post' ELSE 'blurb' END AS body_kind,
        'way ' || o_orderkey % 3 AS via, o_orderdate::DATE AS day, o_orderkey AS seq FROM orders
)"""


def stored_and_arrivals(spark, sf_dir):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    joined = lambda text, n: F.concat(F.lit(text), n.cast("string"))
    stored = table(spark, sf_dir, "customer").where(c % 10 != 9).select(
        c.alias("uid"),
        F.when(c % 2 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(c % 3 == 0, "없음").otherwise(F.col("c_mktsegment")).alias("kind"),
        F.when(c % 4 == 0, "").otherwise(joined("body ", c)).alias("body"),
        F.when(c % 5 == 0, "post").otherwise("blurb").alias("body_kind"),
        F.array(F.lit("feed")).alias("via"),
        F.lit("1995-01-01").cast("date").alias("first_seen"),
        F.lit("1995-01-01").cast("date").alias("last_seen"),
        (c % 11 == 0).alias("forgotten"),
    )
    arrivals = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("uid"),
        F.when(o % 3 == 0, "").otherwise(joined("order ", o)).alias("name"),
        F.when(o % 4 == 0, "[]").otherwise(F.col("o_orderpriority")).alias("kind"),
        F.when(o % 2 == 0, "").otherwise(joined("text ", o)).alias("body"),
        F.when(o % 7 == 0, "post").otherwise("blurb").alias("body_kind"),
        joined("way ", o % 3).alias("via"),
        F.to_date("o_orderdate").alias("day"),
        o.alias("seq"),
    )
    return stored, arrivals


@query(f"""WITH {ARRIVALS}, rows AS (
    SELECT uid, name, kind, body, body_kind, via, first_seen, last_seen, forgotten, 0 AS age, NULL::DATE AS day, 0::BIGINT AS seq FROM stored
    UNION ALL SELECT uid, name, kind, body, body_kind, [via], day, day, false, 1, day, seq FROM arrivals
), gathered AS (
    SELECT uid, arg_min(name, (age, coalesce(day, DATE '1900-01-01'), seq)) FILTER (trim(name) NOT IN ('', '{{}}', '[]', '없음')) AS name,
        arg_min(kind, (age, coalesce(day, DATE '1900-01-01'), seq)) FILTER (trim(kind) NOT IN ('', '{{}}', '[]', '없음')) AS kind,
        arg_min({{'b': body, 'k': body_kind}}, (age, coalesce(day, DATE '1900-01-01'), seq)) FILTER (body <> '') AS b1,
        arg_min({{'b': body, 'k': body_kind}}, (age, coalesce(day, DATE '1900-01-01'), seq)) FILTER (body <> '' AND body_kind = 'post') AS b2,
        array_to_string(list_sort(list_distinct(flatten(list(via)))), ',') AS via, min(first_seen) AS first_seen, max(last_seen) AS last_seen, bool_or(forgotten) AS forgotten
    FROM rows GROUP BY uid
)
SELECT uid, CASE WHEN forgotten THEN '' ELSE coalesce(name, '') END AS name, CASE WHEN forgotten THEN '' ELSE coalesce(kind, '') END AS kind,
    CASE WHEN forgotten THEN '' ELSE coalesce(coalesce(b2, b1).b, '') END AS body, CASE WHEN forgotten THEN '' ELSE coalesce(coalesce(b2, b1).k, '') END AS body_kind,
    via, first_seen, last_seen, forgotten FROM gathered""")
def store_upsert_fill(spark, sf_dir):
    stored, arrivals = stored_and_arrivals(spark, sf_dir)
    return store.upserted(stored, arrivals, ["name", "kind"], ["day", "seq"]).withColumn("via", F.array_join("via", ","))


@query("""WITH stored AS (SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, DATE '2020-01-01' + (c_custkey % 50)::INT AS first_seen, DATE '2021-01-01' + (c_custkey % 70)::INT AS last_seen FROM customer),
moved AS (SELECT CASE WHEN uid % 5 = 0 THEN uid + 1 ELSE uid END AS uid, uid % 5 = 0 AS moved, name, first_seen, last_seen FROM stored)
SELECT uid, arg_min(name, moved::INT) FILTER (name <> '') AS name, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM moved GROUP BY uid""")
def store_replace_preserve(spark, sf_dir):
    c = F.col("c_custkey")
    stored = table(spark, sf_dir, "customer").select(
        c.alias("uid"), F.when(c % 3 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.date_add(F.lit("2020-01-01").cast("date"), (c % 50).cast("int")).alias("first_seen"), F.date_add(F.lit("2021-01-01").cast("date"), (c % 70).cast("int")).alias("last_seen"),
    )
    return store.replaced(stored, stored.where("uid % 5 = 0").select(F.col("uid").alias("old_uid"), (F.col("uid") + 1).alias("uid")))


@query(f"{WITH} SELECT uid, is_new AND source <> 'src1' AS is_new FROM items")
def store_ack(spark, sf_dir):
    return store.acknowledged(items(spark, sf_dir), F.col("source") == "src1").select("uid", "is_new")


@query(f"{WITH} SELECT uid, CASE WHEN coalesce(posted_at < TIMESTAMP '2026-01-05 00:00:00', false) THEN '' ELSE target_org END AS target_org, coalesce(posted_at < TIMESTAMP '2026-01-05 00:00:00', false) AS forgotten FROM items")
def store_forget_older(spark, sf_dir):
    rows = items(spark, sf_dir).select("uid", "target_org", F.coalesce("posted_at", F.lit("2100-01-01").cast("timestamp")).alias("last_seen"), F.lit(False).alias("forgotten"))
    return store.forgotten_before(rows, F.lit("2026-01-05 00:00:00").cast("timestamp"), ["target_org"]).drop("last_seen")


@query("""WITH rows AS (
    SELECT c_custkey AS uid, (c_custkey % 90)::INT AS kr_score, 'k' || c_custkey % 90 AS kr_tier, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS name, 'a' AS source, 0 AS age FROM customer WHERE c_custkey % 4 <> 0
    UNION ALL SELECT o_custkey, (o_orderkey % 100)::INT, 'k' || o_orderkey % 100, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'n' || o_orderkey END, 's' || o_orderkey % 3, 1 FROM orders
)
SELECT uid, max(kr_score) AS kr_score, arg_max(kr_tier, (kr_score, -age, kr_tier)) AS kr_tier, coalesce(arg_min(name, (age, name)) FILTER (name <> ''), '') AS name,
    array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(age) = 1 AS is_first FROM rows GROUP BY uid""")
def store_upsert_maxscore(spark, sf_dir):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    joined = lambda text, n: F.concat(F.lit(text), n.cast("string"))
    stored = table(spark, sf_dir, "customer").where(c % 4 != 0).select(c.alias("uid"), (c % 90).cast("int").alias("kr_score"), joined("k", c % 90).alias("kr_tier"), F.when(c % 2 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("a").alias("source"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), (o % 100).cast("int").alias("kr_score"), joined("k", o % 100).alias("kr_tier"), F.when(o % 2 == 0, "").otherwise(joined("n", o)).alias("name"), joined("s", o % 3).alias("source"))
    return store.upserted_by_score(stored, new, ["kr"], ["name"]).withColumn("sources", F.array_join("sources", ","))


@query("""WITH rows AS (
    SELECT p_partkey AS id, p_size % 3 AS rank, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS status, p_type AS note, [p_brand, p_type] AS links FROM part
    UNION ALL SELECT p_partkey, 3, p_type, p_brand, ['x'] FROM part
)
SELECT id, (list(status ORDER BY rank) FILTER (status <> ''))[1] AS status, array_to_string(CASE WHEN count(DISTINCT note) = 1 THEN [min(note)] ELSE list(note ORDER BY rank) END, ' · ') AS note,
    array_to_string(flatten(list(links ORDER BY rank)), ',') AS links FROM rows GROUP BY id""")
def merge_precedence(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ours = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).cast("int").alias("rank"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("status"), F.col("p_type").alias("note"), F.array("p_brand", "p_type").alias("links"))
    other = p.select(F.col("p_partkey").alias("id"), F.lit(3).alias("rank"), F.col("p_type").alias("status"), F.col("p_brand").alias("note"), F.array(F.lit("x")).alias("links"))
    return store.precedence_merged(ours.unionByName(other), "id", "rank", ["status"], ["note"], ["links"]).withColumn("links", F.array_join("links", ","))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role) || ['feed'])), ',') AS via FROM conversations GROUP BY conv_id")
def set_union_sorted(spark, sf_dir):
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", F.array_join(store.union_sorted(F.col("roles"), F.array(F.lit("feed"))), ",").alias("via"))


@query("""SELECT id, arg_max(role, ("at", new, role)) AS role, max("at") AS "at" FROM (
    SELECT conv_id AS id, turn AS "at", role, 0 AS new FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, role, 1 FROM conversations WHERE turn % 3 = 0) GROUP BY id""")
def set_newest_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), "role")
    return store.newest_wins(rows.where("at % 2 = 0"), rows.where("at % 3 = 0"), "id", "at")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'gone' WHEN a.doc_id IS NULL THEN 'new' ELSE 'changed' END AS change
FROM (SELECT doc_id, source AS v FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE source END AS v FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id
WHERE a.v IS DISTINCT FROM b.v""")
def set_key_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    after = docs.where("doc_id % 5 <> 0").withColumn("source", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("source")))
    return store.key_diff(docs.where("doc_id % 3 <> 0"), after, "doc_id", "source")


@query(f"{WITH} SELECT uid, CASE WHEN actor = '' THEN source WHEN contains(actor, source) THEN actor ELSE actor || ' · ' || source END AS seen_by FROM items")
def set_provenance(spark, sf_dir):
    return items(spark, sf_dir).select("uid", store.with_provenance(F.col("actor"), F.col("source")).alias("seen_by"))


@query("SELECT user_id AS name, ts::DATE AS day, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def store_day_series(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.to_date("ts").alias("day"), "value", "event_id")
    return store.latest_day_series(rows, ["name"], "day", "event_id").drop("event_id")
