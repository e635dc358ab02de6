"""Queries: places and events of the map, matches of channels and questions, briefs, queues and figures of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import places
from saltmarsh.operators import reports
from saltmarsh.operators.order import numbered
from saltmarsh.plans.registry import query, table
from saltmarsh.plans.review import chosen, pick


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


ISLANDS, FEEDS, PLATFORMS, RELATED = ("FORUM", "RANSOMWARE", "TELEGRAM", "", None), ("X", "포럼", None), ("p", " ", "q", "r"), ("직접", "미확인")
DROPS = f"""SELECT event_id, CASE WHEN coalesce(i, '') = '' THEN CASE WHEN s = 'X' THEN 'X 알림 채널(지도 밖)' ELSE '소스 없음' END WHEN trim(p) = '' THEN '게시 플랫폼 없음'
    WHEN event_type = 'error' THEN '날짜 없음' WHEN i = 'RANSOMWARE' AND k <> '직접' THEN '한국 관련 아님' WHEN user_id % 9 = 0 THEN '영토를 정할 수 없음' END AS reason
FROM (SELECT *, {chosen(ISLANDS, 'event_id')} AS i, {chosen(FEEDS, 'event_id')} AS s, {chosen(PLATFORMS, 'event_id')} AS p, {chosen(RELATED, '(event_id // 5)')} AS k FROM events)"""


def dropped(spark, sf_dir):
    e, pick_by = F.col("event_id"), lambda v: pick(v, F.col("event_id"))
    posted, territory = F.when(F.col("event_type") != "error", F.col("ts").cast("string")), F.when(F.col("user_id") % 9 != 0, F.col("user_id"))
    reason = places.drop_reason(pick_by(ISLANDS), pick_by(FEEDS), pick_by(PLATFORMS), posted, pick(RELATED, F.floor(e / 5)), territory)
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query(DROPS)
def map_drop_reason(spark, sf_dir):
    return dropped(spark, sf_dir)


@query(f"SELECT reason, count(*) AS n FROM ({DROPS}) WHERE reason IS NOT NULL GROUP BY reason")
def map_drop_counts(spark, sf_dir):
    return dropped(spark, sf_dir).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, NOT c_custkey % 11 = 0 AND CASE WHEN c_custkey % 7 = 0 THEN known WHEN i = 'FORUM' THEN (live AND (size OR c_acctbal < 0)) OR (c_custkey % 2 = 1 AND known)
    WHEN i = 'TELEGRAM' THEN live AND size ELSE (live AND size) OR known END AS stays
FROM (SELECT *, (['FORUM', 'TELEGRAM', 'RANSOMWARE'])[c_custkey % 3 + 1] AS i, c_nationkey % 2 = 0 AS live, c_acctbal > 5000 AS size, c_nationkey % 5 = 0 AS known FROM customer)""")
def map_stays(spark, sf_dir):
    k, n, b = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    found = places.stays_on_map(
        F.when(k % 11 != 0, True), F.when(k % 7 == 0, "2026-01-02"), pick(("FORUM", "TELEGRAM", "RANSOMWARE"), k), F.when(n % 2 == 0, True), k % 2 == 1,
        F.when(b > 5000, b), F.array(F.lit(None).cast("double"), -b), F.when(n % 5 == 0, 3),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("stays"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN a.c_custkey END, CASE WHEN event_id % 2 = 0 THEN b.c_custkey END, CASE WHEN event_id % 5 < 3 THEN c.c_custkey END) AS channel
FROM events LEFT JOIN customer a ON a.c_custkey = user_id * 3 LEFT JOIN customer b ON b.c_custkey = user_id + 7 LEFT JOIN customer c ON c.c_custkey = event_id % 500 WHERE channel IS NOT NULL""")
def map_event_channel(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(
        e, F.when(e % 3 == 0, F.concat(F.lit("see T.me/s/Chan_"), (u * 3).cast("string"), F.lit("/5"))).otherwise("kit.me/chan_1").alias("platform"),
        F.when(e % 2 == 0, F.concat(F.lit("https://t.me/chan_"), (u + 7).cast("string"))).otherwise("https://xt.me/chan_2").alias("url"),
        F.when(e % 5 < 3, F.concat(F.lit(" CHAN_"), (e % 500).cast("string"))).alias("handle"),
    )
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.concat(F.lit("Chan_"), F.col("c_custkey").cast("string")).alias("name"))
    return reports.event_channels(rows, channels, "event_id")


@query("""WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_suppkey END AS number, CASE WHEN s_suppkey % 3 = 0 THEN 'name' || s_suppkey END AS name, 't' || s_suppkey % 40 AS title,
    CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey * 2 END AS selected FROM supplier),
p AS (SELECT c_custkey AS page, 'n' || c_custkey // 3 AS number, 'name' || c_custkey // 2 AS name, 't' || c_custkey % 60 AS title FROM customer),
m AS (SELECT k, 0 AS kind, page FROM c JOIN p ON c.number = p.number UNION ALL SELECT k, 1, page FROM c JOIN p ON c.name = p.name UNION ALL SELECT k, 2, page FROM c JOIN p ON c.title = p.title),
b AS (SELECT k, kind, count(*) AS n, min(page) AS lowest FROM m GROUP BY k, kind QUALIFY row_number() OVER (PARTITION BY k ORDER BY kind) = 1),
s AS (SELECT c.k AS channel, c.selected, coalesce(n, 0) AS matches, kind, lowest, EXISTS (SELECT 1 FROM m WHERE m.k = c.k AND m.kind = b.kind AND m.page = c.selected) AS picked FROM c LEFT JOIN b ON b.k = c.k),
t AS (SELECT *, CASE WHEN matches = 0 THEN 'stopped_no_match' WHEN kind = 2 THEN CASE WHEN picked THEN 'ready_manual_name_match' ELSE 'stopped_name_only' END WHEN matches = 1 THEN 'ready_auto'
    WHEN picked THEN 'ready_manual' WHEN selected IS NOT NULL THEN 'stopped_invalid_selection' ELSE 'stopped_multiple_matches' END AS status FROM s)
SELECT channel, (['numbers', 'names', 'title'])[kind + 1] AS method, matches, CASE WHEN status = 'ready_auto' THEN lowest WHEN status LIKE 'ready%' THEN selected END AS page, status FROM t""")
def join_channel_target(spark, sf_dir):
    k, text = F.col("s_suppkey"), lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    channels = table(spark, sf_dir, "supplier").select(
        k.alias("channel"), F.array(F.when(k % 2 == 0, text("n", k))).alias("numbers"), F.array(F.when(k % 3 == 0, text("name", k))).alias("names"), text("T", k % 40).alias("title"), F.when(k % 4 < 2, k * 2).alias("selected"),
    )
    c = F.col("c_custkey")
    pages = table(spark, sf_dir, "customer").select(c.alias("page"), F.array(text("n", F.floor(c / 3))).alias("numbers"), F.array(text("name", F.floor(c / 2))).alias("names"), text("t", c % 60).alias("title"))
    return reports.channel_targets(channels, pages)


@query("""WITH q AS (SELECT conv_id || '/' || turn AS question, string_split(text, ' ') AS w FROM conversations), p AS (SELECT question, unnest(w) AS print, generate_subscripts(w, 1) AS pos FROM q),
d AS (SELECT string_split(text, ' ')[1] AS print, doc_id, lang = 'en' AS live FROM documents WHERE text IS NOT NULL), f AS (SELECT print, live, min(doc_id) AS r FROM d GROUP BY print, live),
h AS (SELECT question, live, arg_min(r, pos) AS r FROM p JOIN f USING (print) GROUP BY question, live)
SELECT q.question, CASE WHEN a.r IS NOT NULL THEN 'shown' WHEN b.r IS NOT NULL THEN 'hidden' ELSE 'none' END AS branch, coalesce(a.r, b.r)::VARCHAR AS row
FROM q LEFT JOIN h a ON a.question = q.question AND a.live LEFT JOIN h b ON b.question = q.question AND NOT b.live""")
def rag_rechecked(spark, sf_dir):
    questions = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question"), F.split("text", " ").alias("prints"))
    rows = docs(spark, sf_dir).where("text IS NOT NULL").select(F.get(F.split("text", " "), 0).alias("print"), F.col("doc_id").cast("string").alias("row"), F.col("doc_id").alias("place"), "lang")
    return reports.rechecked(questions, rows.where("lang = 'en'"), rows.where("coalesce(lang, '') <> 'en'"))


@query("""WITH k AS (SELECT s_suppkey AS question, s_suppkey % 6 = 5 AS none, unnest(['k' || s_suppkey % 90, 'k' || s_suppkey % 17 + 100, 'k' || s_suppkey % 7]) AS key FROM supplier),
n AS (SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN 'd' || c_custkey // 2 END AS document, c_custkey % 3 = 0 AS live FROM customer WHERE c_custkey % 4 <> 1),
m AS (SELECT question, none, count(n.key) AS met, list_sort(list(DISTINCT document) FILTER (live AND document IS NOT NULL)) AS docs FROM k LEFT JOIN n ON n.key = k.key AND NOT none GROUP BY question, none)
SELECT question, CASE WHEN none THEN 'none' WHEN len(docs) > 0 THEN 'answerable' WHEN met > 0 THEN 'hidden' ELSE 'unknown' END AS kind, coalesce(array_to_string(docs, ','), '') AS documents FROM m""")
def rag_question_kinds(spark, sf_dir):
    s, c, key = F.col("s_suppkey"), F.col("c_custkey"), lambda n: F.concat(F.lit("k"), n.cast("string"))
    questions = table(spark, sf_dir, "supplier").select(s.alias("question"), (s % 6 == 5).alias("none"), F.array(F.array(key(s % 90), key(s % 17 + 100)), F.array(key(s % 7))).alias("keys"))
    names = table(spark, sf_dir, "customer").where(c % 4 != 1).select(key(c).alias("key"), F.when(c % 5 != 0, F.concat(F.lit("d"), F.floor(c / 2).cast("string"))).alias("document"), (c % 3 == 0).alias("live"))
    return reports.question_kinds(questions, names).withColumn("documents", F.array_join("documents", ","))


REVIEWS, KOREAN = ("사건 O", "사건 X", "미검토", None), ("직접", "간접", "미확인", None, "")


@query(f"""SELECT part, count(*) AS n FROM (SELECT CASE WHEN r = '사건 X' THEN '무관' WHEN k IN ('직접', '간접') OR r = '사건 O' THEN '목록' WHEN n_chars % 2 = 0 AND coalesce(lang, '') <> 'de' THEN '신호 없음' ELSE '미확인' END AS part
FROM (SELECT *, {chosen(REVIEWS, 'doc_id')} AS r, {chosen(KOREAN, 'doc_id')} AS k FROM documents)) GROUP BY part""")
def agg_brief_parts(spark, sf_dir):
    part = places.brief_part(pick(REVIEWS, F.col("doc_id")), pick(KOREAN, F.col("doc_id")), F.when(F.col("n_chars") % 2 != 0, "domain"), F.when(F.col("lang") == "de", "KR"))
    return docs(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '막힌 것' WHEN turn % 4 = 3 THEN '끝난 것' WHEN turn % 3 = 1 THEN '이미 아는 건' WHEN coalesce(text, '') = '' OR conv_id % 2 = 0 THEN '열어야 할 것' ELSE '돌릴 수 있는 것' END AS part FROM conversations""")
def agg_case_parts(spark, sf_dir):
    turn = F.col("turn")
    part = places.case_part(F.when(F.col("role") == "system", "captcha"), F.when(turn % 4 == 3, F.array(F.lit("①"), F.lit("⑥"))), F.when(turn % 3 == 1, True), (F.length("text") > 0) & (F.col("conv_id") % 2 != 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("part"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'http://b' || s_suppkey || '.onion/' WHEN 1 THEN 'http://a' || s_suppkey || '.onion' WHEN 2 THEN '' WHEN 3 THEN 'http://c.onion' ELSE 'u' || s_suppkey END AS main,
    CASE s_suppkey % 5 WHEN 0 THEN 'a' || s_suppkey || '.onion' WHEN 1 THEN 'http://b' || s_suppkey || '.onion/' WHEN 2 THEN 'm1 · m2 · m3 · m4 · m5' ELSE '' END AS mirrors FROM supplier""")
def add_group_addresses(spark, sf_dir):
    kind = "struct<type: string, available: boolean, slug: string, fqdn: string>"
    k, n = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    place = lambda t, up, slug, host: F.struct(F.lit(t).alias("type"), F.lit(up).cast("boolean").alias("available"), F.lit(slug).cast("string").alias("slug"), F.lit(host).cast("string").alias("fqdn")).cast(kind)
    a, b = place("dls", False, None, F.concat(F.lit("a"), n, F.lit(".onion"))), place("DLS", True, F.concat(F.lit("http://b"), n, F.lit(".onion/")), "x")
    chat, dead_b = place("Chat", True, "http://c.onion", None), b.withField("available", F.lit(None).cast("boolean"))
    many = F.array(place("DLS", None, "gopher", None), *[place("DLS", False, x, None) for x in ("m1", "m2", "m2", "m3", "m4", "m5", "m6")])
    said = F.when(k == 0, F.array(chat, a, b)).when(k == 1, F.array(a, chat, dead_b)).when(k == 2, many).when(k == 3, F.array(chat))
    found = places.group_addresses(said, F.concat(F.lit("u"), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("f")).select("s_suppkey", "f.main", "f.mirrors")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE page_id % 3 WHEN 0 THEN 'a' || page_id || '.co.kr,b.kr' ELSE '' END AS domains, page_id % 4 <> 3 AS accepted FROM pages""")
def add_forum_rows(spark, sf_dir):
    k = F.col("page_id")
    domains = F.when(k % 3 == 0, F.array(F.concat(F.lit("A"), k.cast("string"), F.lit(".co.KR")), F.lit("x.com"), F.lit("b.kr"), F.lit("no kr"))).when(k % 3 == 1, F.array(F.lit("a.krx")))
    port = F.regexp_replace("url", "^(https?://[^/?#]+)", F.when(F.startswith("url", F.lit("https")), "$1:443").otherwise("$1:80"))
    bad = F.when(k % 4 == 3, F.concat(F.lit("ftp"), F.col("url"))).otherwise(port)
    return table(spark, sf_dir, "pages").select("page_id", places.forum_host(port).alias("host"), F.array_join(places.korean_domains(domains), ",").alias("domains"), places.forum_host(bad).isNotNull().alias("accepted"))


@query("""WITH v AS (SELECT *, (['confirmed', 'review', 'none'])[c_custkey % 3 + 1] AS tier, CASE WHEN c_custkey % 4 > 0 THEN (['direct', 'critical', 'sector'])[c_custkey % 3 + 1] ELSE 'none' END AS supply FROM customer)
SELECT 'all' AS what, 'total' AS name, count(*) AS n FROM v UNION ALL SELECT 'all', 'new', count(*) FROM v WHERE c_acctbal > 0 UNION ALL SELECT 'tier', tier, count(*) FROM v GROUP BY tier UNION ALL SELECT 'supply', supply, count(*) FROM v GROUP BY supply
UNION ALL (SELECT 'group', 'g' || c_nationkey, count(*) AS n FROM v WHERE c_custkey % 100 >= 60 GROUP BY c_nationkey ORDER BY n DESC, 2 LIMIT 15)""")
def agg_victim_figures(spark, sf_dir):
    k = F.col("c_custkey")
    victims = table(spark, sf_dir, "customer").select(
        pick(("confirmed", "review", "none"), k).alias("tier"), F.when(k % 4 > 0, pick(("direct", "critical", "sector"), k)).alias("supply"), (F.col("c_acctbal") > 0).alias("is_new"),
        (k % 100).alias("score"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("group"),
    )
    return reports.victim_figures(victims)


@query("""WITH r AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, value > 50 AS korean, event_id FROM events), m AS (SELECT user_id, day[1:7] AS month, count(*) AS n FROM r WHERE korean AND event_id % 5 > 0 GROUP BY ALL),
s AS (SELECT user_id, string_agg(month || ' 한국 ' || n || '건', ' · ' ORDER BY month || ' 한국 ' || n || '건') AS said FROM m GROUP BY user_id)
SELECT r.user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS venues, min(CASE WHEN event_id % 5 > 0 THEN day END) AS first_day, string_agg(DISTINCT 's' || event_id % 3, ',' ORDER BY 's' || event_id % 3) AS sources,
    CASE WHEN bool_or(event_id % 11 = 0) THEN '판매자' ELSE '미확인' END AS role, coalesce(any_value(said), '') AS korean FROM r LEFT JOIN s ON s.user_id = r.user_id GROUP BY r.user_id""")
def agg_actor_attributes(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("place"), F.when(e % 5 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("day"), F.concat(F.lit("s"), (e % 3).cast("string")).alias("source"),
        F.when(e % 11 == 0, "DB 판매").alias("nature"), (F.col("value") > 50).alias("korean"),
    )
    return reports.actor_attributes(rows, "user_id").withColumns({"venues": F.array_join("venues", ","), "sources": F.array_join("sources", ",")})


@query("""SELECT doc_id, row_number() OVER (ORDER BY CASE v WHEN '사건 O' THEN 0 WHEN '사건 X' THEN 1 ELSE 2 END, doc_id) AS place FROM (SELECT d.doc_id, (['사건 X', '확신 낮음', '사건 O'])[quality + toxic + 1] AS v
FROM documents d JOIN labels USING (doc_id) WHERE lang <> 'de')""")
def add_pending(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").select("doc_id", F.get(F.array(*map(F.lit, ("사건 X", "확신 낮음", "사건 O"))), (F.col("quality") + F.col("toxic")).cast("int")).alias("verdict"))
    rank = F.when(F.col("verdict") == "사건 O", 0).when(F.col("verdict") == "사건 X", 1).otherwise(2)
    return numbered(docs(spark, sf_dir).where("lang <> 'de'").select("doc_id").join(judged, "doc_id"), rank, F.col("doc_id")).select("doc_id", "place")


@query("""SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) + to_seconds((user_id % 5 + 1) * 86400 + 10800) WHEN 1 THEN TIMESTAMP '2026-01-02 00:00:00' END AS expiry FROM events""")
def store_recorded(spark, sf_dir):
    k = F.col("event_id") % 3
    arrivals = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("ts").alias("at"), pick(reports.SAYERS, F.col("event_id")).alias("src"), pick(reports.STATES, F.col("event_id")).alias("state"),
        F.when(k < 2, F.concat((F.col("user_id") % 5 + 1).cast("string"), F.lit(" days 3 hours"))).alias("countdown"), F.when(k == 1, F.lit("2026-01-02 00:00:00").cast("timestamp")).alias("expiry"),
    )
    return reports.recorded(arrivals).select("event_id", "event_type", "expiry")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de' AND n_chars % 4 = 0)")
def set_kept_answers(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "source")
    return reports.kept_answers(rows, docs(spark, sf_dir).where("lang = 'de' AND n_chars % 4 = 0"), "source")


@query("SELECT event_id, user_id AS uid, c_name, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def join_observed_items(spark, sf_dir):
    observations = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("uid"))
    return reports.observed_items(observations, table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "uid"), ["c_name", "c_mktsegment"])


@query("""SELECT page_id, url FROM pages WHERE contains(lower(url), 'korea') OR contains(lower(url), '/de/') OR contains(lower(url), '.kr') ORDER BY page_id % 7 DESC, page_id LIMIT 20""")
def flt_newest_korean(spark, sf_dir):
    title = F.replace(F.col("url"), F.lit("/de/"), F.lit("/Korea/"))
    return reports.newest(table(spark, sf_dir, "pages"), places.names_korea(title), F.col("page_id") % 7, F.col("page_id"), 20).select("page_id", "url")
