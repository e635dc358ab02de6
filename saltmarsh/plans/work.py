"""Queries: queues and panels, names, notices, keywords, text cells that no other query covers, and tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import names, outputs, review, text, times
from saltmarsh.operators import queues
from saltmarsh.plans.registry import query, table
from saltmarsh.sources import feeds, sinks
from saltmarsh.sources.working import new_path


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 3 THEN '보류' WHEN n_name = 'CHINA' THEN '국가 한국' WHEN o_orderpriority LIKE '1%' THEN '포럼' WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN '전에 판정함' END AS reason
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P') GROUP BY reason""")
def add_review_queue(spark, sf_dir):
    orders, customer, nation, supplier = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "supplier"))
    country = F.when(F.col("n_name") == "CHINA", " Korea ").otherwise(F.col("n_name"))
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("o_orderkey").alias("case"), "o_custkey", F.when(F.col("o_orderstatus") != "P", "미검토").otherwise("사건 O").alias("review"), country.alias("country"), F.when(F.col("o_orderpriority").startswith("1"), "포럼").otherwise("랜섬웨어").alias("source")
    )
    judged = rows.join(supplier, F.col("o_custkey") == F.col("s_suppkey"), "left_semi").select("case")
    return queues.review_queue(rows, rows.where("case % 10 = 3").select("case"), judged).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT event_id, newest FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') WHEN user_id % 2 = 0 THEN strftime(ts, '%Y-%m') ELSE '2020-01-01' END AS newest FROM events
WHERE value * 2 >= 60 OR CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 7 * 10 END >= 50) ORDER BY newest DESC, event_id LIMIT 200""")
def flt_either_axis(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").alias("uid"), (F.col("value") * 2).alias("kr_score"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 7 * 10).alias("supply_score"),
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd")).otherwise("").alias("discovered"), F.when(F.col("user_id") % 2 == 0, F.date_format("ts", "yyyy-MM")).alias("published"), F.lit("2020-01-01").alias("first_seen"),
    )
    return queues.on_either_axis(rows, 60, 50, 200).select("event_id", "newest")


@query("""SELECT c_mktsegment AS kind, col AS "column", count(*) AS n FROM (SELECT c_mktsegment, unnest(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['name', 'phone', 'balance'] WHEN c_mktsegment = 'AUTOMOBILE' THEN ['phone'] ELSE ['name', 'balance'] END) AS col FROM customer) GROUP BY ALL""")
def flt_dropped_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.create_map(F.lit("name"), "c_name", F.lit("phone"), F.lit("1"), F.lit("balance"), F.col("c_acctbal").cast("string")).alias("metadata"))
    segments = rows.select("kind").distinct()
    allowed = segments.where("kind = 'AUTOMOBILE'").select("kind", F.explode(F.array(F.lit("name"), F.lit("balance"))).alias("column")).unionByName(segments.where("kind IN ('FURNITURE', 'HOUSEHOLD')").select("kind", F.lit("phone").alias("column")))
    return queues.dropped_columns(queues.allowed_columns(rows, allowed))


@query("""WITH q AS (SELECT o_custkey AS question, list_sort(list(DISTINCT o_orderdate::DATE::VARCHAR) FILTER (o_orderstatus <> 'F')) AS now FROM orders GROUP BY o_custkey)
SELECT c_custkey AS question, CASE WHEN now IS NULL THEN 'empty' WHEN c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING') THEN 'same' ELSE 'todo' END AS state FROM customer LEFT JOIN q ON question = c_custkey WHERE c_custkey % 5 <> 0""")
def rag_to_prepare(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    evidence = orders.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("question"), F.to_date("o_orderdate").cast("string").alias("hash"))
    k = F.col("c_custkey")
    held = evidence.groupBy("question").agg(F.collect_list("hash").alias("hashes")).join(customer, k == F.col("question"))
    answers = held.select("question", F.when(k % 2 == 0, F.col("hashes")).otherwise(F.array(F.lit("old"))).alias("hashes"), (k % 3 == 0).alias("reviewed"), F.when(F.col("c_mktsegment") == "BUILDING", "now").otherwise("before").alias("model"))
    return queues.to_prepare(customer.where(k % 5 != 0).select(k.alias("question")), evidence, answers, "now")


@query("""SELECT 'source' AS what, event_type AS name, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS at FROM events WHERE event_id % 9 <> 0 GROUP BY event_type
UNION ALL (SELECT 'run', o_orderpriority, o_custkey::BIGINT, strftime(o_orderdate, '%Y-%m-%d') FROM orders ORDER BY o_orderkey DESC LIMIT 20)""")
def agg_panel(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("first_seen"), (F.col("event_id") % 9 == 0).alias("forgotten"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("fresh"))
    return queues.panel(items, runs)


@query(r"""WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS body FROM documents),
m AS (SELECT doc_id, '**' || source || ' ' || lang || '**' || chr(10) || 'Company: ' || source || ' ' || lang || chr(10) || 'Actor: 못 봄' || chr(10) || 'Type: 확인 못 함' || chr(10) || 'Posted: 2024-01-02' || chr(10) || 'Seen: 2024-01-03' || chr(10) || 'Venue: ' || source
    || CASE WHEN lang = 'en' THEN chr(10) || 'Original: <https://x.example/' || doc_id || '>' ELSE '' END || chr(10) || 'Country: ' || upper(lang)
    || CASE WHEN body <> '' THEN chr(10) || chr(10) || '```' || chr(10) || CASE WHEN length(body) <= 700 THEN body ELSE rtrim(body[:699], ' ') || '…' END || chr(10) || '```' ELSE '' END
    || chr(10) || chr(10) || '_이 줄은 단서다. 확인한 것이 아니다. 원 게시물을 보기 전에 검증을 시작하지 않는다._' AS t FROM d)
SELECT doc_id, CASE WHEN length(t) <= 1900 THEN t ELSE rtrim(t[:1899], ' ') || '…' END AS notice FROM m""")
def push_notice(spark, sf_dir):
    none = F.lit(None).cast("string")
    org = F.concat("source", F.lit(" "), "lang")
    row = {"org": org, "title": none, "actor": F.lit(" "), "kind": none, "posted_at": F.lit("2024-01-02"), "first_seen": F.lit("2024-01-03"), "venue": F.col("source"), "url": F.when(F.col("lang") == "en", F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))), "country": F.upper("lang"), "body": F.col("text")}
    return table(spark, sf_dir, "documents").select("doc_id", queues.notice(row).alias("notice"))


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n')) AS raw, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), 1) AS k FROM documents),
c AS (SELECT doc_id, k, regexp_replace(raw, '^[ \t\-–—•|·]+|[ \t\-–—•|·]+$', '', 'g') AS line FROM l),
g AS (SELECT * FROM c WHERE length(line) BETWEEN 3 AND 120 AND length(line) - length(replace(line, ' ', '')) <= 12 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY k) = 1)
SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY k)) AS lines_md5 FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 800) GROUP BY doc_id""")
def add_candidate_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", queues.candidate_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    return lines.select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "\n")).alias("lines_md5"))


KEYWORDS = ["The", "und", "que", "zz"]


@query("""SELECT conv_id AS file, keyword, CASE WHEN turn = 0 THEN '머리' ELSE role END AS label, turn AS number FROM conversations, (VALUES ('The'), ('und'), ('que'), ('zz')) k(keyword) WHERE contains(lower(text), lower(keyword))""")
def add_keyword_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("number"), F.col("text").alias("line"), F.when(F.col("turn") != 0, F.col("role")).alias("label"))
    return queues.keyword_hits(rows, KEYWORDS)


@query(rf"""WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z]{{3,}}')[1:3], lambda w: upper(w[1]) || w[2:]) AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN w[1] || ' ' || w[2] || ' Inc' WHEN 2 THEN w[1] || '@x.org' WHEN 3 THEN w[1] || '.com' WHEN 4 THEN lower(w[1]) || ' ' || w[2] ELSE w[1] || ', ' || w[2] || ' J.' END AS name, doc_id % 6 AS k, w FROM n WHERE len(w) = 3)
SELECT doc_id, k = 2 OR k IN (0, 5) AND NOT regexp_matches(name, '{names.ORGANISATION}') AS person FROM s""")
def text_like_a_person(spark, sf_dir):
    words = F.transform(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), 1, 3), lambda w: F.initcap(w))
    k = F.col("doc_id") % 6
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    name = F.when(k == 0, F.concat(a, F.lit(" "), b)).when(k == 1, F.concat(a, F.lit(" "), b, F.lit(" Inc"))).when(k == 2, F.concat(a, F.lit("@x.org"))).when(k == 3, F.concat(a, F.lit(".com"))).when(k == 4, F.concat(F.lower(a), F.lit(" "), b)).otherwise(F.concat(a, F.lit(", "), b, F.lit(" J.")))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") == 3).select("doc_id", names.like_a_person(name).alias("person"))


@query(r"""SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, 'Forum' AS shown, CASE WHEN regexp_matches(regexp_extract(url, '//([^/.]+)', 1), '^[A-Za-z0-9-]{1,24}$') AND contains(regexp_extract(url, '//([^/]+)', 1), '.') THEN regexp_extract(url, '//([^/.]+)', 1) END AS head FROM pages""")
def text_display_name(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/]+)", 1)
    raw = F.concat(F.when(F.col("page_id") % 2 == 0, "Forum.World").otherwise("Forum"), F.lit(" ("), host, F.lit(")"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), names.display_name(raw).alias("shown"), names.domain_head(raw).alias("head"))


@query(r"""SELECT doc_id, length(text) - length(replace(replace(text, chr(8203), ''), chr(8238), '')) AS hidden, md5(regexp_replace(replace(replace(text, chr(8203), ''), chr(8238), ''), '([\\`*_{}\[\]()#+\-.!|>~])', '\\\1', 'g')) AS escaped_md5
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(8203) || coalesce(text, '') || chr(8238) ELSE coalesce(text, '') END AS text FROM documents)""")
def text_hidden_and_escaped(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("​"), F.coalesce("text", F.lit("")), F.lit("‮"))).otherwise(F.coalesce("text", F.lit("")))
    bare = F.regexp_replace(said, text.HIDDEN, "")
    return table(spark, sf_dir, "documents").select("doc_id", text.hidden_count(said).cast("long").alias("hidden"), F.md5(text.escaped_markdown(bare)).alias("escaped_md5"))


@query(r"""WITH v AS (SELECT doc_id, regexp_replace(regexp_replace('<p class="x">' || coalesce(text, '') || '</p> <!-- y -->', '<[^>]{0,400}?>', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, trim(regexp_replace(t, '[ \t\x{a0}]{2,}', ' ', 'g'), ' ') AS t FROM v)
SELECT doc_id, CASE WHEN length(t) > 2000 THEN rtrim(t[:2000], ' ') || '…' ELSE t END AS said FROM s""")
def text_sanitized(spark, sf_dir):
    """Documents in tags; their texts hold no character references, which SQL cannot decode and a test covers."""
    page = F.concat(F.lit('<p class="x">'), F.coalesce("text", F.lit("")), F.lit("</p> <!-- y -->"))
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitized(page).alias("said"))


@query("""SELECT event_id, date_trunc('second', ts) AS at, (o_orderdate::DATE - ts::DATE)::INT AS gap, CASE WHEN value < 60 THEN round(value)::BIGINT || '분' WHEN value * 60 < 1440 THEN NULL ELSE NULL END AS mean FROM (SELECT * FROM events JOIN orders ON o_orderkey = event_id) WHERE value < 60 AND value % 1 <> 0.5""")
def text_times(spark, sf_dir):
    """The same moment in five ways of writing it, read back; the gap to an order's day; a mean interval in words."""
    k = F.col("event_id") % 5
    second = F.date_trunc("second", "ts")
    epoch = F.unix_timestamp(second)
    said = F.when(k == 0, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, epoch.cast("string")).when(k == 2, (epoch * 1000).cast("string")).when(k == 3, F.date_format(second, "EEE, d MMM yyyy HH:mm:ss Z")).otherwise(F.date_format(second, "yyyy/MM/dd HH:mm:ss"))
    rows = table(spark, sf_dir, "events").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("event_id")).where("value < 60 AND value % 1 <> 0.5")
    return rows.select("event_id", times.parse_timestamp(said).cast("timestamp_ntz").alias("at"), times.day_gap(F.to_date("o_orderdate"), F.to_date("ts")).alias("gap"), times.interval_text(F.col("value")).alias("mean"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '직접' ELSE '미확인' END AS direct, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN '국가만 · ' || '집계처 국가 태그' WHEN o_orderstatus <> 'F' AND o_custkey % 3 = 0 THEN o_orderpriority || ' · ' || '사람이 고름' WHEN o_custkey % 2 = 0 AND o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS reasons
FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0)""")
def push_reasons(spark, sf_dir):
    tier = F.when(F.col("o_orderstatus") == "F", "likely").otherwise("weak")
    rows = table(spark, sf_dir, "orders").where("NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0)")
    told = review.reasons_text(tier, F.array("o_orderpriority"), F.col("o_custkey") % 3 == 0, "국가만", "사람이 고름")
    return rows.select("o_orderkey", review.direct(tier).alias("direct"), told.alias("reasons"))


@query("""SELECT 'by_type' AS statistic, event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'by_status', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def snk_statistics(spark, sf_dir):
    """Statistics written as CSV, one folder each, and read back; a statistic without rows is not written over what is there."""
    folder = new_path(spark, "statistics")
    found = {"by_type": table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")), "by_status": table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"))}
    sinks.write_statistics(found, folder)
    parts = [spark.read.option("header", True).schema("name string, n long").csv(f"{folder}/{s}").select(F.lit(s).alias("statistic"), "name", "n") for s in found]
    return parts[0].unionByName(parts[1])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1""")
def snk_versions(spark, sf_dir):
    """Two versions behind a pointer, of which the last is read; an empty feed after them changes nothing."""
    folder, rows = new_path(spark, "index"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sinks.write_version(rows.where("c_custkey % 2 = 0"), folder, "a")
    sinks.write_version(rows.where("c_custkey % 2 = 1"), folder, "b")
    sinks.write_if_any(rows.where("c_custkey < -1"), f"{folder}/version=b")
    return sinks.current_version(spark, folder)


@query(r"""SELECT conv_id, turn AS number, '' AS why, 'c' || conv_id || '/' || turn AS post, '2024-01-0' || (turn % 9 + 1) AS at, role AS channel_name, trim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10)) AS text, ['https://x.example/' || turn] AS links FROM conversations WHERE conv_id % 4 <> 0
UNION ALL SELECT conv_id, NULL, CASE conv_id % 3 WHEN 0 THEN '미리보기가 꺼져 있다. 이 채널은 공개 미리보기로 못 본다. 실계정 경로(나)가 필요하다' WHEN 1 THEN '채널 쪽은 받았는데 글 묶음이 없다. 채널이 비었거나 꼴이 바뀌었다' ELSE '채널 쪽이 아닌 것을 받았다. 주소를 확인할 것' END, NULL, NULL, NULL, NULL, NULL FROM conversations WHERE conv_id % 4 = 0 GROUP BY conv_id""")
def src_channel_page(spark, sf_dir):
    """Conversations as pages of channels, a turn a post; every fourth page has none, for three reasons."""
    turn = F.col("turn").cast("string")
    body = F.replace(F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br/>"))
    post = F.concat(
        F.lit('<div class="tgme_widget_message " data-post="c'), F.col("conv_id").cast("string"), F.lit("/"), turn, F.lit('"><a class="tgme_widget_message_owner_name x"><span dir="auto">'), "role",
        F.lit('</span></a><time datetime="2024-01-0'), (F.col("turn") % 9 + 1).cast("string"), F.lit('"><div class="tgme_widget_message_text js" dir="auto">'), body, F.lit('<a href="https://x.example/'), turn, F.lit('"></a></div></div>'),
    )
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("p")))), lambda x: x["p"]), "\n").alias("posts"))
    k = F.col("conv_id") % 3
    none = F.when(k == 0, '<a class="tgme_page_context_link">').when(k == 1, '<div class="tgme_page">').otherwise("<html>")
    pages = talks.select("conv_id", F.lit("?").alias("channel"), F.when(F.col("conv_id") % 4 != 0, F.col("posts")).otherwise(none).alias("page"))
    found = feeds.channel_page(pages, "page", "channel")
    bare = lambda c: F.when(F.col("why") == "", F.col(c)).alias(c)
    return found.select("conv_id", F.regexp_extract("post", r"/(\d+)$", 1).try_cast("long").alias("number"), "why", *[bare(c) for c in ("post", "at", "channel_name", "text", "links")])


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, w[1] AS a, w[2] AS b, w[3] AS c FROM w WHERE len(w) > 2)
SELECT doc_id, a AS org, b || chr(10) || c || chr(10) || chr(10) || a AS summary, CASE WHEN doc_id % 2 = 0 THEN c ELSE b END AS size, CASE WHEN doc_id % 3 = 0 THEN ['대상'] WHEN doc_id % 3 = 1 THEN ['대상', '요약'] ELSE ['대상', '요약'] END AS filled, CASE WHEN doc_id % 3 = 0 THEN ['요약'] ELSE [] END AS clashes FROM n""")
def add_labelled_cells(spark, sf_dir):
    """A tool's output of a document's first words, read into cells; those fill blank cells, and clash with the summary of every third row."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 2)
    a, b, c = (F.get("w", F.lit(k)) for k in range(3))
    text = F.format_string("# title: no\n대상: %s   (from a list)\n규모: %s\n  요약: %s  \n    %s\n\n     %s\n- list: no\n    no value\n규모: %s\n비고:\n--- page ---\n뒤: no\n", a, F.when(F.col("doc_id") % 2 == 0, b).otherwise(c), b, c, a, F.when(F.col("doc_id") % 2 == 0, c).otherwise(b))
    read = rows.select("doc_id", outputs.labelled(text, "--- page ---").alias("m"))
    k = F.col("doc_id") % 3
    held = F.create_map(F.lit("요약"), F.when(k == 0, "something else").when(k == 1, "").otherwise("못 봄(이유)"))
    done = read.withColumn("s", outputs.seated(held, F.map_filter("m", lambda n, _: n != "규모")))
    return done.select("doc_id", F.col("m")["대상"].alias("org"), F.col("m")["요약"].alias("summary"), F.col("m")["규모"].alias("size"), "s.filled", "s.clashes")


@query(r"""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS found, ts::DATE::TIMESTAMP - INTERVAL 9 HOUR AS "start", ts::DATE::TIMESTAMP + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND AS "end" FROM events""")
def push_found_day(spark, sf_dir):
    raw = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("발견일"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("discovered")))
    bounds = outputs.day_bounds(F.to_date("ts"), F.to_date("ts"), "Asia/Seoul")
    rows = table(spark, sf_dir, "events").select("event_id", outputs.found_day(raw).alias("found"), bounds.alias("b"))
    return rows.select("event_id", "found", F.col("b.start").cast("timestamp_ntz").alias("start"), F.col("b.end").cast("timestamp_ntz").alias("end"))


@query(rf"""SELECT doc_id, CASE WHEN trim(t, ' ') = '' THEN '빈칸' WHEN doc_id % 5 = 1 THEN 'N/A' WHEN doc_id % 5 = 2 THEN '회사 소개(AI 가 지음)' WHEN regexp_matches(t, '{outputs.POST_LIKE}') THEN '게시글 문장' ELSE '회사 소개로 보임' END AS kind
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'n/a' WHEN 2 THEN ' [AI generated] ' || coalesce(text, '') WHEN 3 THEN 'Selling the database of ' || coalesce(text, '') ELSE coalesce(text, '') END AS t FROM documents)""")
def text_description_kind(spark, sf_dir):
    k, said = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    text_of = F.when(k == 1, "n/a").when(k == 2, F.concat(F.lit(" [AI generated] "), said)).when(k == 3, F.concat(F.lit("Selling the database of "), said)).otherwise(said)
    return table(spark, sf_dir, "documents").select("doc_id", outputs.description_kind(text_of).alias("kind"))
