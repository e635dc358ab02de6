"""Queries: matching, channels and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions.text import bare_key, domain
from saltmarsh.operators import channel, matching, profile
from saltmarsh.plans.canonical import ITEMS_SQL, items
from saltmarsh.plans.registry import query, table

ITEMS = f"WITH {ITEMS_SQL}"


@query(f"""{ITEMS}, rows AS (SELECT uid, source || '|' || venue || '|' || uid % 50 AS key FROM items), known AS (SELECT uid, source || '|' || venue || '|' || uid % 50 AS key FROM items WHERE uid % 6 = 0)
SELECT key, min(uid) AS uid FROM rows WHERE uid NOT IN (SELECT uid FROM known) AND key NOT IN (SELECT key FROM known) GROUP BY key""")
def join_anti_dedupe(spark, sf_dir):
    key = F.concat_ws("|", "source", "venue", (F.col("uid") % 50).cast("string"))
    rows = items(spark, sf_dir).select("uid", key.alias("key"))
    return matching.new_rows(rows, rows.where("uid % 6 = 0"), F.col("uid"))


@query("""WITH reg AS (SELECT s_suppkey AS id, s_name AS name, 'alias ' || s_suppkey % 40 AS alias FROM supplier),
byname AS (SELECT lower(name) AS key, min(id) AS id FROM reg GROUP BY 1 HAVING count(DISTINCT id) = 1), byalias AS (SELECT alias AS key, min(id) AS id FROM reg GROUP BY 1 HAVING count(DISTINCT id) = 1),
rows AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 2 = 0 THEN 'supplier#' || lpad((c_custkey % 300)::VARCHAR, 9, '0') ELSE 'x' END AS name, 'alias ' || c_custkey % 60 AS alias FROM customer)
SELECT row, coalesce(n.id, a.id) AS match, CASE WHEN n.id IS NOT NULL THEN 0 WHEN a.id IS NOT NULL THEN 1 END AS level FROM rows LEFT JOIN byname n ON n.key = rows.name LEFT JOIN byalias a ON a.key = rows.alias""")
def join_cascade_match(spark, sf_dir):
    c = F.col("c_custkey")
    registry = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.concat(F.lit("alias "), (F.col("s_suppkey") % 40).cast("string")).alias("alias"))
    rows = table(spark, sf_dir, "customer").select(
        c.alias("row"), F.when(c % 2 == 0, F.concat(F.lit("supplier#"), F.lpad((c % 300).cast("string"), 9, "0"))).otherwise("x").alias("name"), F.concat(F.lit("alias "), (c % 60).cast("string")).alias("other")
    )
    return matching.cascade(rows, [F.col("name"), F.col("other")], registry, [F.array(F.lower("s_name")), F.array("alias")]).select("row", "match", "level")


@query("SELECT regexp_replace(lower(p_name), '[^0-9a-z가-힣]', '', 'g') AS key, min(p_partkey) AS id FROM part GROUP BY 1")
def join_first_writer(spark, sf_dir):
    return matching.first_registered(table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey")), bare_key(F.col("p_name")), F.col("id"))


@query("""WITH choices AS (SELECT DISTINCT p_type AS choice FROM part), rows AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 1 THEN 'abc' ELSE p_type END AS name FROM part)
SELECT p_partkey, name, choice FROM rows LEFT JOIN choices ON lower(choice) = lower(name)""")
def join_option(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    rows = p.select("p_partkey", F.when(k == 0, F.lower("p_type")).when(k == 1, "abc").otherwise(F.col("p_type")).alias("name"))
    return matching.options(rows, bare_key(F.col("name")), p.select(F.col("p_type").alias("choice")).distinct(), bare_key(F.col("choice")))


@query(f"""{ITEMS}, seen AS (SELECT CASE WHEN uid % 3 = 0 THEN upper(actor) ELSE actor END AS handle, replace(actor, ' ', '') AS key FROM items WHERE actor <> ''), spelled AS (SELECT key, handle, count(*) AS n FROM seen WHERE key NOT IN (SELECT 'actor' || r_regionkey FROM region) GROUP BY 1, 2)
SELECT key, arg_min(handle, (-n, handle)) AS handle, sum(n)::BIGINT AS n FROM spelled GROUP BY key""")
def join_alias_handle(spark, sf_dir):
    seen = items(spark, sf_dir).where("actor <> ''").select(F.when(F.col("uid") % 3 == 0, F.upper("actor")).otherwise(F.col("actor")).alias("handle"), bare_key(F.col("actor")).alias("key"))
    return matching.unknown_handles(seen, table(spark, sf_dir, "region").select(F.concat(F.lit("actor"), F.col("r_regionkey").cast("string")).alias("key")))


@query("""WITH linked AS (SELECT doc_id AS id, unnest([doc_id + 1, doc_id + 2, doc_id]) AS "case", unnest([0, 1, 2]) AS pos FROM labels)
SELECT l.doc_id AS id, arg_min(k."case", pos) FILTER (k."case" % 3 = 0 AND k."case" IN (SELECT doc_id FROM documents)) AS first_case, count(*) FILTER (k."case" % 3 = 0 AND k."case" IN (SELECT doc_id FROM documents)) AS n_cases
FROM labels l JOIN linked k ON k.id = l.doc_id GROUP BY l.doc_id""")
def join_first_case(spark, sf_dir):
    d = F.col("doc_id")
    verified = table(spark, sf_dir, "labels").select(d.alias("id"), F.array(d + 1, d + 2, d).alias("cases"))
    return matching.first_case(verified, table(spark, sf_dir, "documents").where(d % 3 == 0).select(d.alias("case")))


@query("""WITH linked AS (SELECT s_suppkey AS id, unnest([s_nationkey, s_nationkey + 30, s_nationkey + 1]) AS key, unnest([0, 1, 2]) AS pos FROM supplier)
SELECT id, coalesce(string_agg(n_name, ',' ORDER BY pos), '') AS names, count(*) FILTER (n_nationkey IS NULL) AS unmatched FROM linked LEFT JOIN nation ON n_nationkey = key GROUP BY id""")
def join_id_map(spark, sf_dir):
    n = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(n, n + 30, n + 1).alias("ids"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return matching.mapped(rows, "ids", names).select("id", F.array_join("values", ",").alias("names"), "unmatched")


@query("""WITH sites AS (SELECT page_id AS id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS site FROM pages)
SELECT id, CASE WHEN site = 'example.com' OR ends_with(site, '.example.com') THEN 'com' ELSE 'net' END AS vendor FROM sites WHERE site IN ('example.com', 'example.net') OR ends_with(site, '.example.com') OR ends_with(site, '.example.net')""")
def join_domain_suffix(spark, sf_dir):
    vendors = spark.createDataFrame([("example.net", "net", 2), ("example.com", "com", 1)], "domain string, vendor string, place int")
    return matching.vendor_matches(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), domain(F.col("url")).alias("site")), "site", vendors)


SITE = r"regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '')"


@query(f"""WITH hosts AS (SELECT DISTINCT {SITE} AS host FROM pages WHERE page_id % 3 = 0), p AS (
    SELECT page_id AS id, {SITE} AS own, list_distinct([{SITE}, 'h' || page_id % 4 || '.org', 'tionsh.example.net']) AS links FROM pages
), e AS (SELECT id, unnest(links) AS host, own FROM p)
SELECT id, coalesce(string_agg(host, ',' ORDER BY host) FILTER (host IN (FROM hosts)), '') AS named, count(*) FILTER (host NOT IN (FROM hosts)) AS unknown FROM e WHERE host <> own GROUP BY id""")
def join_host_links(spark, sf_dir):
    own = domain(F.col("url"))
    body = F.concat(F.lit("see "), F.col("url"), F.lit(" and https://h"), (F.col("page_id") % 4).cast("string"), F.lit(".org/x, http://tionsh.example.net"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), own.alias("own"), body.alias("body"))
    return matching.hosts_named(pages, "body", "own", pages.where("id % 3 = 0").select(F.col("own").alias("host"))).withColumn("named", F.array_join("named", ","))


#: Names of the parts' makers: with legal forms, as part of another name, and as a domain.
@query("""WITH r AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 7 = 0)
SELECT p_partkey AS id FROM part WHERE p_partkey % 5 <> 2 AND p_name IN (SELECT name FROM r)""")
def join_same_org(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    said = F.when(k == 0, F.concat("p_name", F.lit(" Co., Ltd."))).when(k == 1, F.concat(F.lit("(주)"), F.upper("p_name"))).when(k == 2, F.concat(F.lit("Other "), "p_name"))
    said = said.when(k == 3, F.concat(F.lit("x (https://www."), F.replace("p_name", F.lit(" ")), F.lit(".co.kr/notice)"))).otherwise(F.concat("p_name", F.lit(" (KR)")))
    return matching.same_organisation(part.select(F.col("p_partkey").alias("id"), said.alias("name")), part.where("p_partkey % 7 = 0").select(F.col("p_name").alias("name")))


@query("""WITH t AS (SELECT unnest(['ing', 'der', 'tion', 'der the', 'onth', '的', '是的', 'de la']) AS token),
d AS (SELECT doc_id AS id, lower(text) AS low, regexp_replace(lower(text), '\\s+', '', 'g') AS squeezed FROM documents)
SELECT id, token FROM d, t WHERE CASE WHEN regexp_full_match(token, '[a-z0-9]{1,3}') THEN regexp_matches(low, '(^|[^a-z0-9])' || token || '([^a-z0-9]|$)') ELSE contains(low, token) OR contains(squeezed, token) END AND length(token) >= 2""")
def join_contains_org(spark, sf_dir):
    tokens = spark.createDataFrame([("ING",), ("der",), ("Tion",), ("der the",), ("onth",), ("是的",), ("de la",)], "token string")
    return matching.mentioning(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), tokens)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'fixed' ELSE p_brand END AS p_brand FROM part")
def join_override(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    return matching.overridden(p, p.where("id % 10 = 0").select("id", F.lit("fixed").alias("value")), "p_brand")


@query("SELECT count(*) AS n, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS id FROM customer WHERE contains(lower(c_name), 'customer#000000017')")
def join_resolve_one(spark, sf_dir):
    return matching.resolved(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), "Customer#000000017")


@query("""WITH s AS (SELECT conv_id, arg_min(role, turn) AS starter FROM conversations GROUP BY 1) SELECT role AS author, count(DISTINCT c.conv_id) AS threads FROM conversations c JOIN s USING (conv_id) WHERE role <> starter GROUP BY 1""")
def join_reply_authors(spark, sf_dir):
    posts = table(spark, sf_dir, "conversations").withColumnRenamed("role", "author")
    return matching.reply_authors(posts, "conv_id", "turn", "author")


@query("""WITH r AS (SELECT p_partkey AS id, 'http://u/' || p_partkey % 500 AS url, p_name AS org, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'h' || p_partkey % 3 END AS handle, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'f' || p_partkey % 2 END AS forum FROM part),
n AS (SELECT * FROM r WHERE id % 97 = 3), pairs AS (SELECT DISTINCT a.id AS row, b.id AS "case", a.url = b.url AS same, a.handle AS ah, b.handle AS bh, a.forum AS af, b.forum AS bf FROM r a JOIN n b
ON a.url = b.url OR a.org = b.org)
SELECT row, "case", CASE WHEN same THEN 'same' WHEN ah IS NULL OR bh IS NULL THEN 'unknown' WHEN ah <> bh THEN 'partly different' WHEN af IS NULL OR bf IS NULL THEN 'unknown' WHEN af <> bf THEN 'repost' ELSE 'same' END AS class FROM pairs""")
def dup_case_classify(spark, sf_dir):
    p = F.col("p_partkey")
    name = lambda prefix, k: F.concat(F.lit(prefix), (p % k).cast("string"))
    rows = table(spark, sf_dir, "part").select(p.alias("id"), name("http://u/", 500).alias("url"), F.col("p_name").alias("org"), F.when(p % 4 != 0, name("h", 3)).alias("handle"), F.when(p % 5 != 0, name("f", 2)).alias("forum"))
    return matching.duplicate_cases(rows, rows.where("id % 97 = 3"))


# Channels: a conversation is a channel, a turn a message an hour after the one before.
MESSAGES = "messages AS (SELECT conv_id AS channel, turn AS id, role AS sender, text, TIMESTAMP '2026-03-01 00:00:00' + (turn * turn * 7 + conv_id % 13) * INTERVAL 1 HOUR AS sent_at FROM conversations)"
TERMS = {"greeting": ("the", "and"), "sale": ("der", "und"), "leak": ("que", "les")}


def messages(spark, sf_dir):
    hours = F.col("turn") * F.col("turn") * 7 + F.col("conv_id") % 13
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel"), F.col("turn").alias("id"), F.col("role").alias("sender"), "text", F.timestamp_seconds(F.lit(1772323200) + hours * 3600).alias("sent_at"))


def has(*terms: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)')"


@query(f"WITH {MESSAGES} SELECT channel, CASE WHEN {has('the', 'and')} THEN 'greeting' WHEN {has('der', 'und')} THEN 'sale' WHEN {has('que', 'les')} THEN 'leak' ELSE 'other' END AS type, count(*) AS n FROM messages GROUP BY 1, 2")
def chan_types(spark, sf_dir):
    return channel.message_types(messages(spark, sf_dir), F.col("text"), TERMS)


@query(f"""WITH {MESSAGES}, hits AS (SELECT channel, unnest(list_filter([CASE WHEN {has('the', 'and')} THEN 'greeting' END, CASE WHEN {has('der', 'und')} THEN 'sale' END, CASE WHEN {has('que', 'les')} THEN 'leak' END], lambda x: x IS NOT NULL)) AS category FROM messages)
SELECT category, count(*) AS n, count(DISTINCT channel) AS channels FROM hits GROUP BY 1""")
def chan_categories(spark, sf_dir):
    return channel.categories(messages(spark, sf_dir), F.col("text"), TERMS)


COUNTED = "counted AS (SELECT 'sender' AS dimension, sender AS value, count(*) AS n FROM messages GROUP BY 2 UNION ALL SELECT 'day', strftime(sent_at, '%Y-%m-%d'), count(*) FROM messages GROUP BY 2 UNION ALL SELECT 'word', w, count(*) FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM messages) GROUP BY 2)"


def chan_counted(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    return channel.counters(messages(spark, sf_dir), {"sender": F.array("sender"), "day": F.array(F.date_format("sent_at", "yyyy-MM-dd")), "word": found})


@query(f"WITH {MESSAGES}, {COUNTED} SELECT * FROM counted")
def chan_counters(spark, sf_dir):
    return chan_counted(spark, sf_dir)


@query(f"""WITH {MESSAGES}, {COUNTED}, placed AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS k, sum(n) OVER (PARTITION BY dimension) AS total FROM counted)
SELECT dimension, string_agg(value || ' ' || n || ' (' || floor(n * 100 / total)::BIGINT || '%)', ', ' ORDER BY k) AS text FROM placed WHERE k <= 3 GROUP BY dimension""")
def chan_top_shares(spark, sf_dir):
    return channel.top_text(chan_counted(spark, sf_dir), "dimension", "value", "n", 3)


@query("SELECT event_id, '$' || regexp_replace(printf('%.2f', value), '\\.0+$', '') AS price FROM events")
def chan_price(spark, sf_dir):
    said = F.concat(F.lit("only $ "), F.format_string("%.2f", "value"), F.lit(" now"))
    return table(spark, sf_dir, "events").select("event_id", channel.price(said).alias("price"))


@query(f"""WITH {MESSAGES} SELECT channel, count(*) AS n, min(sent_at) AS first_at, max(sent_at) AS last_at, count(DISTINCT sent_at::DATE) AS active_days,
CASE WHEN count(*) > 1 THEN round((epoch(max(sent_at)) - epoch(min(sent_at))) / 60 / (count(*) - 1), 3) END AS mean_minutes, round(count(*) / count(DISTINCT sent_at::DATE), 4) AS per_day FROM messages GROUP BY channel""")
def chan_cadence(spark, sf_dir):
    return channel.cadence(messages(spark, sf_dir), "sent_at")


@query(f"""WITH {MESSAGES}, s AS (SELECT channel, sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS latin FROM messages GROUP BY 1) SELECT channel, CASE WHEN latin > 0 THEN 'latin' ELSE 'mixed' END AS dominant, CASE WHEN latin > 0 THEN 'latin' ELSE '' END AS listed FROM s""")
def chan_language_share(spark, sf_dir):
    return channel.languages(messages(spark, sf_dir), F.col("text"))


@query(f"""WITH {MESSAGES}, s AS (SELECT channel, count(*) AS n, count(*) FILTER (sender = 'assistant') AS replies, count(*) FILTER (sender = 'system') AS notes FROM messages GROUP BY 1)
SELECT *, CASE WHEN notes >= 0.3 * n THEN 'notices' WHEN replies >= 0.5 * n THEN 'answers' ELSE 'mixed' END AS role FROM s""")
def chan_role(spark, sf_dir):
    stats = messages(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.count_if(F.col("sender") == "assistant").alias("replies"), F.count_if(F.col("sender") == "system").alias("notes"))
    return channel.role(stats, {"notices": ("notes", 0.3), "answers": ("replies", 0.5)})


@query("SELECT event_id, value, user_id FROM events ORDER BY value DESC, user_id DESC, event_id LIMIT 20")
def chan_top_messages(spark, sf_dir):
    return channel.top_messages(table(spark, sf_dir, "events").select("event_id", "value", "user_id"), ["value", "user_id"], "event_id", 20)


@query(f"""WITH {MESSAGES}, w AS (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]{{2,}}')) AS word FROM messages) SELECT word, count(*) AS n FROM w WHERE word NOT IN ('the', 'of') GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def chan_word_freq(spark, sf_dir):
    return channel.word_counts(messages(spark, sf_dir), F.col("text"), ("the", "of"), 25)


@query("SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) >= 10")
def chan_operators(spark, sf_dir):
    posts = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return channel.operators_of(posts, "user_id", F.col("event_type") == "click", 10)


@query("""WITH s AS (SELECT doc_id, source, n_chars, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM documents) SELECT doc_id, source, n_chars FROM s WHERE so_far <= 20000""")
def srt_capped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    return channel.capped(docs, "source", [F.col("doc_id")], "text", 20_000).drop("text")


PART_CELLS = """cells AS (SELECT 'p_name' AS "column", nullif(trim(p_name), '') AS value FROM part UNION ALL SELECT 'p_brand', nullif(trim(p_brand), '') FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT 'p_blank', CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'test' || p_partkey % 3 END FROM part)"""
COLUMNS = ["p_name", "p_brand", "p_size", "p_blank"]


def sample(spark, sf_dir):
    blank = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.concat(F.lit("test"), (F.col("p_partkey") % 3).cast("string")))
    return table(spark, sf_dir, "part").withColumn("p_blank", blank)


@query(f"""WITH {PART_CELLS} SELECT "column", count(*) AS n, count(value) AS filled, count(DISTINCT value) AS distinct_values, CASE WHEN count(value) > 0 THEN floor((count(value) - count(DISTINCT value)) * 100 / count(value))::BIGINT END AS repeated_percent,
min(length(value))::INT AS min_length, max(length(value))::INT AS max_length, round(sum(length(value)) / count(value), 4) AS mean_length FROM cells GROUP BY "column" """)
def prof_column_stats(spark, sf_dir):
    return profile.column_stats(sample(spark, sf_dir), COLUMNS)


@query(f"""WITH {PART_CELLS} SELECT "column", CASE WHEN count(*) FILTER (regexp_matches(value, '^-?\\d+$')) * 2 >= count(value) THEN 'integer' ELSE 'text' END AS type FROM cells WHERE value IS NOT NULL GROUP BY "column" """)
def prof_type_guess(spark, sf_dir):
    return profile.value_types(sample(spark, sf_dir), COLUMNS)


@query(f"""WITH {PART_CELLS}, v AS (SELECT "column", value, count(*) AS k FROM cells WHERE value IS NOT NULL GROUP BY 1, 2), s AS (SELECT "column", sum(k) AS n, sum(k) FILTER (starts_with(value, 'test')) AS d, max(k) AS m FROM v GROUP BY 1)
SELECT "column", floor(coalesce(d, 0) * 100 / n)::BIGINT AS dummy_percent, floor(m * 100 / n)::BIGINT AS top_percent, n >= 20 AND floor(m * 100 / n) >= 20 AS suspicious FROM s""")
def prof_synth_marks(spark, sf_dir):
    return profile.synthetic_marks(sample(spark, sf_dir), COLUMNS)


@query("SELECT conv_id, count(*) > 1 AND max(turn) - min(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS increments FROM conversations GROUP BY conv_id")
def prof_auto_increment(spark, sf_dir):
    return profile.auto_increment(table(spark, sf_dir, "conversations"), "conv_id", "turn")


PATHS = "paths AS (SELECT 'data/' || p_type || '/' || CASE p_partkey % 6 WHEN 0 THEN 'dump.sql' WHEN 1 THEN 'passwords.txt' WHEN 2 THEN 'customer_' || p_size || '.dat' WHEN 3 THEN 'report.pdf' WHEN 4 THEN '.env' ELSE 'x.bin' END AS path FROM part)"


def paths(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "dump.sql").when(k == 1, "passwords.txt").when(k == 2, F.concat(F.lit("customer_"), F.col("p_size").cast("string"), F.lit(".dat"))).when(k == 3, "report.pdf").when(k == 4, ".env").otherwise("x.bin")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("data/"), "p_type", F.lit("/"), name).alias("path"))


@query(f"""WITH {PATHS} SELECT CASE WHEN ends_with(path, '.env') OR ends_with(path, 'passwords.txt') THEN '치명' WHEN ends_with(path, '.sql') OR contains(path, 'customer') THEN '높음' WHEN ends_with(path, '.pdf') THEN '중간' ELSE '낮음' END AS grade, count(*) AS n FROM (SELECT DISTINCT path FROM paths) GROUP BY 1""")
def prof_tree_grade(spark, sf_dir):
    return profile.path_grades(paths(spark, sf_dir))


@query(f"WITH {PATHS} SELECT regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1) AS extension, 2 AS depth, count(*) AS n FROM (SELECT DISTINCT path FROM paths) GROUP BY 1")
def prof_path_shapes(spark, sf_dir):
    return profile.path_shapes(paths(spark, sf_dir))


@query("""SELECT 'p_brand' AS "column", 'changed' AS change, count(*) FILTER (p_partkey % 5 = 0 AND p_partkey % 7 <> 0) AS n FROM part UNION ALL SELECT 'p_brand', 'blanked', count(*) FROM part WHERE p_partkey % 7 = 0""")
def prof_reparse_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    brand = F.when(F.col("p_partkey") % 7 == 0, "").when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.col("p_brand"))
    return profile.diff_histogram(p, p.withColumn("p_brand", brand), "p_partkey", ["p_name", "p_brand"])


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS word FROM part) SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 3""")
def rag_common_words(spark, sf_dir):
    return profile.common_words(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY p_type, p_name) AS n, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN n > 1 THEN p_name || ' ' || k ELSE p_name END AS label FROM n""")
def win_number_duplicates(spark, sf_dir):
    return profile.numbered_names(table(spark, sf_dir, "part"), "p_type", "p_name", "p_partkey").select("p_partkey", "label")


@query("""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n""")
def win_slug(spark, sf_dir):
    return profile.slugs(table(spark, sf_dir, "part"), F.col("p_name"), "p_partkey").select("p_partkey", "slug")
