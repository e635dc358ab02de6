"""Queries: rows sent to the register of events, and lists of events."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from saltmarsh.functions import events as lists
from saltmarsh.functions import outbound as out
from saltmarsh.functions.times import quarter_key
from saltmarsh.operators import events as listed
from saltmarsh.operators import outbound
from saltmarsh.operators.order import numbered
from saltmarsh.plans.registry import query, table
from saltmarsh.plans.review import STATES, chosen, pick

SOURCES = ("ransom", "telegram", "forum", "kit", "x", " ransomlive ", "web", None)
TIERS = ("none", "review", "likely", None)
NOTED = ("https://t.me/chan_1/77", "https://t.me/ab/1", None)
NUMBERS = ("chan.two/15", "no number", None, "c-3/9")
KINDS = ("DB 판매", "other", None)
PLACES = ("dls", "telegram", "none", None)
SIZES = ("12 GB", "-", "n/a", None, "3,400건")

#: Rows made from the documents: the first line is the title, the first word of it an organisation.
ITEMS = f"""WITH items AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'u' || doc_id // 2 END AS uid, {chosen(SOURCES, "doc_id")} AS source,
    string_split(text, chr(10))[1] AS title, CASE WHEN n_chars % 3 = 0 THEN string_split(text, ' ')[1] END AS org,
    CASE n_chars % 5 WHEN 0 THEN false WHEN 1 THEN true END AS ours, {chosen(TIERS, "n_chars")} AS tier, source AS venue,
    CASE WHEN n_chars % 2 = 0 THEN 'https://h.example/' || n_chars END AS post_url, {chosen(NOTED, "n_chars")} AS noted, {chosen(NUMBERS, "(n_chars // 3)")} AS number,
    {chosen(KINDS, "n_chars")} AS kind, {chosen(PLACES, "n_chars")} AS place_kind, {chosen(SIZES, "n_chars")} AS size, lang FROM documents) """
URL = r"""CASE WHEN trim(coalesce(source, '')) = 'telegram' THEN CASE WHEN regexp_full_match(coalesce(noted, ''), 'https://t\.me/[A-Za-z0-9_]{3,64}/[0-9]+') THEN noted
    WHEN regexp_full_match(coalesce(number, ''), '[A-Za-z0-9_.\-]+/[0-9]+') THEN 'https://t.me/' || number ELSE coalesce(post_url, '') END ELSE coalesce(post_url, '') END"""
NAME = "CASE trim(coalesce(source, '')) WHEN 'ransom' THEN '랜섬웨어' WHEN 'ransomlive' THEN '랜섬웨어' WHEN 'telegram' THEN '텔레그램' WHEN 'forum' THEN '포럼' WHEN 'kit' THEN '포럼' WHEN 'x' THEN 'X' END"


def items(spark, sf_dir):
    docs, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    return docs.select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit("u"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("uid"),
        pick(SOURCES, F.col("doc_id")).alias("source"), F.get(F.split("text", "\n"), 0).alias("title"), F.when(n % 3 == 0, F.get(F.split("text", " "), 0)).alias("org"),
        F.when(n % 5 == 0, False).when(n % 5 == 1, True).alias("ours"), pick(TIERS, n).alias("tier"), F.col("source").alias("venue"),
        F.when(n % 2 == 0, F.concat(F.lit("https://h.example/"), n.cast("string"))).alias("post_url"), pick(NOTED, n).alias("noted"), pick(NUMBERS, F.floor(n / 3)).alias("number"),
        pick(KINDS, n).alias("kind"), pick(PLACES, n).alias("place_kind"), pick(SIZES, n).alias("size"), "lang",
    )


@query(ITEMS + f"""SELECT doc_id, f OR o OR (p AND NOT coalesce(ours, true) = false AND coalesce(tier, 'none') <> 'none') AS send,
    CASE WHEN f THEN '사람이 킷을 돌린 글' WHEN o OR NOT p THEN '' WHEN ours = false THEN '유출 글이 아닙니다'
        WHEN tier IN ('review', 'likely') THEN '대상 조직을 못 읽었지만 한국 신호가 있습니다: ' || tier || ' · ' || coalesce(venue, '-') ELSE '' END AS reason
FROM (SELECT *, coalesce({NAME} = '포럼', false) AS f, trim(coalesce(org, '')) <> '' AS o, coalesce({NAME} IN ('텔레그램', 'X'), false) AS p FROM items)""")
def push_eligible(spark, sf_dir):
    found = out.eligible(F.col("source"), F.col("org"), F.col("ours"), F.col("tier"), F.array("tier", F.coalesce("venue", F.lit("-"))))
    return items(spark, sf_dir).select("doc_id", found.alias("e")).select("doc_id", "e.send", "e.reason")


def with_url(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("url", out.event_url(F.col("source"), F.col("post_url"), F.col("noted"), F.col("number")))
    return rows.withColumn("key", out.event_key(F.col("url"), F.col("title"), F.col("venue")))


@query(ITEMS + f"SELECT doc_id, {URL} AS url FROM items")
def push_source_url(spark, sf_dir):
    return with_url(spark, sf_dir).select("doc_id", "url")


@query(ITEMS + f""", keyed AS (SELECT doc_id, uid, lang, CASE WHEN {URL} <> '' THEN {URL} ELSE trim(title) || '|' || trim(coalesce(venue, '')) END AS key FROM items)
SELECT doc_id, (trim(uid) <> '' AND uid IN (SELECT uid FROM keyed WHERE lang = 'en')) OR key IN (SELECT key FROM keyed WHERE lang = 'en') AS seen FROM keyed""")
def push_seen(spark, sf_dir):
    rows = with_url(spark, sf_dir)
    stored = rows.where("lang = 'en'").select("uid", "key")
    return outbound.marked_seen(rows.select("doc_id", "uid", "key"), stored, "uid", "key").select("doc_id", "seen")


@query(ITEMS + f"""SELECT doc_id, name, value FROM (
    SELECT doc_id, '자료 제목' AS name, substring(title, 1, 2000) AS value FROM items UNION ALL SELECT doc_id, '대상 조직', org FROM items
    UNION ALL SELECT doc_id, '게시 플랫폼', venue FROM items UNION ALL SELECT doc_id, '원문 URL', {URL} FROM items
    UNION ALL SELECT doc_id, '게시 성격', CASE WHEN kind = 'DB 판매' THEN kind WHEN place_kind = 'dls' THEN '랜섬웨어 유출' WHEN place_kind = 'telegram' THEN '확인 못 함' END FROM items
    UNION ALL SELECT doc_id, '소스', {NAME} FROM items UNION ALL SELECT doc_id, 'UID', uid FROM items
    UNION ALL SELECT doc_id, '주장 규모', CASE WHEN size IN ('12 GB', '3,400건') THEN size END FROM items) WHERE trim(value) NOT IN ('', '-', '—', '–', '?', '--', '---', 'na', 'n/a', 'N/A', 'unknown', 'Unknown')""")
def push_properties(spark, sf_dir):
    c = {k: F.col(k) for k in ("title", "org", "venue", "url", "uid", "size", "kind", "place_kind", "source")}
    values = {
        "자료 제목": c["title"], "대상 조직": c["org"], "게시 플랫폼": c["venue"], "원문 URL": c["url"], "게시 성격": out.nature(c["kind"], c["place_kind"]),
        "소스": out.source_name(c["source"]), "UID": c["uid"], "주장 규모": c["size"],
    }
    return with_url(spark, sf_dir).select("doc_id", F.explode(out.properties(values)).alias("name", "value"))


@query(f"""SELECT DISTINCT lower(c_mktsegment || CASE WHEN c_nationkey % 4 = 0 THEN ' ' || c_custkey ELSE '' END) AS name FROM customer
WHERE {chosen(STATES, 'c_custkey')} = '사건 O' AND c_nationkey % 4 <> 1
UNION SELECT 'test-' || c_custkey FROM customer WHERE {chosen(STATES, 'c_custkey')} = '사건 O' AND c_nationkey % 4 = 1 AND c_nationkey % 8 = 1""")
def push_confirmed_names(spark, sf_dir):
    nation, number = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    org = F.when(nation % 4 == 0, F.concat("c_mktsegment", F.lit(" "), number)).when(nation % 8 == 1, F.concat(F.lit(" TEST-"), number)).when(nation % 8 == 5, pick(("Bank", "12345", "abc", None), F.col("c_custkey"))).otherwise(F.col("c_mktsegment"))
    return outbound.confirmed_names(table(spark, sf_dir, "customer"), pick(STATES, F.col("c_custkey")), org)


NOW = datetime.datetime(2024, 3, 5, 7, 30)
PERIODS = {"7": ("days", 7), "90": ("days", 90), "all": ("all",), "range": ("range", "2024-01-10", "2024-02-01"), "cut": ("range", "2024-02-20", "2025-01-01"), "behind": ("range", "2024-05-01", "2024-05-31")}
#: Events with their time as written: in Seoul's time, in UTC, or as a day.
WRITTEN = """WITH written AS (SELECT *, CASE event_id % 3 WHEN 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+09:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%d') END AS posted,
    CASE event_id % 3 WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS moment FROM events) """


def written(spark, sf_dir):
    events, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    text = lambda at, form: F.date_format(at, form)
    seoul = F.concat(text(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    return events.withColumn("posted", F.when(k == 0, seoul).when(k == 1, text("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(text("ts", "yyyy-MM-dd")))


@query(WRITTEN + """SELECT p.period, first_day, last_day, event_id FROM written, (VALUES ('7', '2024-02-27', '2024-03-05', 7), ('90', '2023-12-06', '2024-03-05', 90), ('all', NULL, '2024-03-05', 100000),
    ('range', '2024-01-10', '2024-02-01', NULL), ('cut', '2024-02-20', '2024-03-05', NULL), ('behind', '2023-12-06', '2024-03-05', 90)) AS p(period, first_day, last_day, days)
WHERE moment <= TIMESTAMP '2024-03-05 07:30:00' AND CASE WHEN days IS NULL THEN posted[1:10] BETWEEN first_day AND last_day ELSE moment > TIMESTAMP '2024-03-05 07:30:00' - to_days(days::INT) END""")
def evt_period(spark, sf_dir):
    def days(name):
        return F.struct(F.lit(name).alias("period"), *[F.lit(d).cast("string").alias(n) for n, d in zip(("first_day", "last_day"), lists.period_days(PERIODS[name], NOW), strict=True)])

    held = F.array_compact(F.array(*[F.when(lists.in_period(F.col("posted"), p, NOW), days(name)) for name, p in PERIODS.items()]))
    return written(spark, sf_dir).select("event_id", F.inline(held)).select("period", "first_day", "last_day", "event_id")


@query(WRITTEN + "SELECT event_id, row_number() OVER (ORDER BY posted[1:16] DESC, moment DESC, event_id) AS place FROM written")
def evt_newest(spark, sf_dir):
    return numbered(written(spark, sf_dir), *lists.newest_first(F.col("posted"), F.col("event_id"))).select("event_id", "place")


@query(WRITTEN + """SELECT event_id, posted[1:7] AS month, count(*) OVER (PARTITION BY posted[1:7]) AS in_month,
    row_number() OVER (PARTITION BY posted[1:7] ORDER BY posted[1:16] DESC, moment DESC, event_id) AS place_in_month FROM written""")
def evt_by_month(spark, sf_dir):
    return listed.by_month(written(spark, sf_dir), "posted", "event_id").select("event_id", "month", "in_month", "place_in_month")


@query(WRITTEN + "SELECT event_id, CASE event_id % 3 WHEN 2 THEN posted[1:10] ELSE strftime(moment, '%Y-%m-%d %H:%M UTC') END AS stamp FROM written")
def evt_utc_stamp(spark, sf_dir):
    return written(spark, sf_dir).select("event_id", lists.utc_stamp(F.col("posted")).alias("stamp"))


@query(WRITTEN + """SELECT event_id, '[' || CASE WHEN user_id % 2 = 0 THEN 'KR · ' ELSE '' END || CASE WHEN event_type <> 'error' THEN event_type || ' · ' ELSE '' END || posted[1:10]
    || CASE event_id % 4 WHEN 0 THEN ' · ' || format('{:,}', round(value * 100)::BIGINT) || '건' WHEN 1 THEN ' · ' || rtrim(rtrim(printf('%.2f', value), '0'), '.') || 'GB' ELSE '' END || ']' AS title FROM written""")
def evt_title(spark, sf_dir):
    k = F.col("event_id") % 4
    value, unit = F.when(k == 0, F.round(F.col("value") * 100)).when(k != 2, F.col("value")), F.when(k == 0, "건").when(k != 3, "GB")
    found = lists.title(F.when(F.col("user_id") % 2 == 0, "KR"), F.when(F.col("event_type") != "error", F.col("event_type")), F.col("posted"), value, unit)
    return written(spark, sf_dir).select("event_id", found.alias("title"))


@query("""SELECT n_nationkey AS relation, event_id AS event FROM nation, events WHERE event_id IN (n_nationkey * 3, n_nationkey * 7) OR (n_regionkey < 3 AND user_id = n_nationkey AND event_id % 5 = n_regionkey)""")
def evt_touching(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    relations = table(spark, sf_dir, "nation").select(n.alias("relation"), F.when(F.col("n_regionkey") < 3, "activity").otherwise("trade").alias("kind"), n.alias("from"), F.col("n_regionkey").cast("long").alias("to"), F.array(n * 3, n * 7, n * 3).alias("evidence"))
    return listed.touching(relations, table(spark, sf_dir, "events").select(F.col("event_id").alias("event"), F.col("user_id").alias("actor"), (F.col("event_id") % 5).alias("territory")))


NATURES = ("랜섬웨어 유출", "DB 판매", None)


@query("""SELECT doc_id, own, CASE WHEN own <> '' THEN own = '랜섬웨어' ELSE nature IS NOT NULL AND nature = '랜섬웨어 유출' END AS ransom, own = '텔레그램' AS telegram FROM (
SELECT doc_id, """ + chosen(("랜섬웨어", "텔레그램", "", "포럼"), "doc_id") + " AS own, " + chosen(NATURES, "doc_id") + " AS nature FROM documents)")
def evt_source_pick(spark, sf_dir):
    own, nature = pick(("랜섬웨어", "텔레그램", "", "포럼"), F.col("doc_id")), pick(NATURES, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("own"), lists.of_source(own, nature, "ransom").alias("ransom"), lists.of_source(own, nature, "telegram").alias("telegram"))


@query("""SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS count, CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN
    (sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) - sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END))::BIGINT END AS trend FROM events GROUP BY user_id""")
def evt_recent_kpi(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "click").cast("long").alias("recent30"), (F.col("event_type") == "error").cast("long").alias("prev30"))
    return listed.recent_kpi(rows, ["user_id"], "recent30", "prev30")


@query("""SELECT center, min(q) AS first_quarter FROM (SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, unnest([o_custkey, o_orderkey % 40]) AS center FROM orders)
WHERE q <> '1995-Q1' GROUP BY center""")
def rel_first_quarter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(quarter_key(F.to_date("o_orderdate")).alias("quarter"), F.col("o_custkey").alias("from"), (F.col("o_orderkey") % 40).alias("to"))
    return listed.first_quarters(rows, "quarter", F.lit("1995-Q1"))
