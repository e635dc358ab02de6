"""Queries: what pages say of a venue, totals in forums' words, what bars the way, and values with how they are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import states, webpages
from saltmarsh.plans.registry import query, table

VISIBLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\s+', ' ', 'g'))"""


def _sign(name: str, strong: bool) -> str:
    return " OR ".join(f"regexp_matches(blob, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p, s in webpages.SIGNALS[name] if s == strong) or "false"


STRENGTH = ", ".join(f"CASE WHEN {_sign(n, True)} THEN 'strong' WHEN {_sign(n, False)} THEN 'weak' END AS s{k}" for k, n in enumerate(webpages.SIGNALS))


@query(rf"""WITH p AS (SELECT page_id, html, {VISIBLE} AS text FROM pages), b AS (SELECT *, coalesce(html, '') || ' ' || text AS blob FROM p), s AS (SELECT page_id, html, text, {STRENGTH} FROM b)
SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5,
    substr(trim(regexp_replace(regexp_replace(CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) ELSE regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) END, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 200) AS title,
    coalesce(s1 = 'strong' OR s2 = 'strong' OR s3 = 'strong' OR s4 = 'strong', false) AS signup_required,
    coalesce(nullif(concat_ws(', ', CASE WHEN s5 = 'strong' THEN '봇 차단 페이지' END, CASE s0 WHEN 'strong' THEN '캡차 있음' WHEN 'weak' THEN '캡차 가능성(약한 근거)' END, CASE WHEN s3 IS NOT NULL THEN '초대코드 필요' END,
        CASE WHEN s4 = 'strong' THEN '가입비·보증금 언급' END, CASE WHEN s2 = 'strong' THEN '회원가입 필요' WHEN s1 = 'strong' THEN '로그인 필요' WHEN s1 IS NOT NULL OR s2 IS NOT NULL THEN '로그인·가입 링크 있음(약한 근거)' END), ''),
        CASE WHEN coalesce(s0, s1, s2, s3, s4, s5) IS NULL THEN '공개 접근 (로그인·캡차 신호 없음)' ELSE '신호 약함' END) AS how_to_enter,
    len(regexp_extract_all(html, '(?i)href=["'']([^"''\s>]{{1,300}})'))::BIGINT AS n_links
FROM s""")
def web_page_signals(spark, sf_dir):
    page = F.col("html")
    read = table(spark, sf_dir, "pages").select("page_id", webpages.visible_text(page).alias("text"), webpages.title(page).alias("title"), webpages.gate(page).alias("gate"), webpages.links(page, F.lit("")).n.alias("n_links"))
    return read.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "title", "gate.signup_required", "gate.how_to_enter", "n_links")


@query(r"""WITH d AS (SELECT page_id, coalesce(html, '') || ' mail m' || page_id || '@proton.me or t.me/join_' || page_id || ' and T.me/share, 0x' || md5(page_id::VARCHAR) || '00000000 <a href="https://www.' || regexp_extract(url, '//([^/]+)', 1) || '/x">x</a>' AS page, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages)
SELECT page_id, list_slice(list_distinct(list_filter(regexp_extract_all(page, '(?i)(?:t\.me/|telegram(?:\.me)?[:/@\s]{1,3})([A-Za-z0-9_]{5,32})', 1), lambda h: lower(h) NOT IN ('share'))), 1, 3) AS handles, ['m' || page_id || '@proton.me'] AS mails,
    ['0x' || md5(page_id::VARCHAR) || '00000000'] AS eth, list_contains(list_transform(regexp_extract_all(page, '(?i)href=["'']([^"''\s>]{1,300})', 1), lambda h: regexp_replace(lower(regexp_extract(h, '(?i)^https?://([^/:?#]+)', 1)), '^[w.]+', '')), host) AS own_host FROM d""")
def web_contacts(spark, sf_dir):
    k, host = F.col("page_id").cast("string"), F.regexp_extract("url", "//([^/]+)", 1)
    more = F.concat(F.lit(" mail m"), k, F.lit("@proton.me or t.me/join_"), k, F.lit(" and T.me/share, 0x"), F.md5(k), F.lit('00000000 <a href="https://www.'), host, F.lit('/x">x</a>'))
    page = F.concat(F.coalesce("html", F.lit("")), more)
    read = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), webpages.contacts(page).alias("c"), webpages.wallets(page).alias("w"), webpages.links(page, F.lit("")).domains.alias("d"))
    return read.select("page_id", F.col("c")["telegram"].alias("handles"), F.col("c")["email"].alias("mails"), F.col("w")["eth"].alias("eth"), F.array_contains("d", F.col("host")).alias("own_host"))


@query("""SELECT c_custkey, (c_custkey * 37 + 1)::BIGINT AS members, c_custkey % 3 = 2 AS members_about, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 1000 + 500)::BIGINT END AS posts FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 2)
UNION ALL SELECT c_custkey, c_custkey * 1000 + 500, true, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 1000 + 500 END FROM customer WHERE c_custkey % 3 = 2""")
def web_totals(spark, sf_dir):
    k = F.col("c_custkey")
    n = F.format_number(k * 37 + 1, 0)
    rough = F.concat(k.cast("string"), F.lit(".5K"))
    members = F.when(k % 3 == 0, F.concat(F.lit("Members: "), n)).when(k % 3 == 1, F.concat(F.lit("We currently have "), n, F.lit(" members."))).otherwise(F.concat(F.lit("Total members: "), rough))
    text = F.concat("c_name", F.lit(" Members online: 45 and Most active Members: 77 at night. "), members, F.lit(" "), F.when(k % 2 == 0, F.concat(F.lit("Total posts: "), rough)).otherwise("Posts today: 12"), F.lit(" "), "c_comment" if "c_comment" in table(spark, sf_dir, "customer").columns else F.lit("end"))
    read = table(spark, sf_dir, "customer").select("c_custkey", webpages.total(text, webpages.MEMBERS).alias("m"), webpages.total(text, webpages.POSTS).alias("p"))
    return read.select("c_custkey", F.col("m.n").alias("members"), F.col("m.about").alias("members_about"), F.col("p.n").alias("posts"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN '클라우드플레어 규칙에 막힙니다' ELSE '클라우드플레어에 막힙니다' END WHEN c_nationkey % 5 = 1 THEN '원서버가 막습니다' WHEN c_nationkey % 5 = 2 THEN '무엇이 막는지 못 알아냈습니다'
    ELSE lower(c_mktsegment) || ' 가 막습니다' END AS blocker FROM customer""")
def web_blocker(spark, sf_dir):
    k = F.col("c_nationkey")
    server = F.when(k % 5 == 0, F.lit("CloudFlare")).when(k % 5 == 2, F.lit("")).otherwise(F.concat("c_mktsegment", F.lit("/1.2")))
    body = F.when(k % 2 == 0, "Error 1020").otherwise("Error")
    body = F.concat("c_name", F.lit(" "), F.when(k % 5 == 1, "Access Denied").otherwise(body))
    return table(spark, sf_dir, "customer").select("c_custkey", webpages.blocker(F.create_map(F.lit("Server"), server, F.lit("Date"), F.lit("x")), body).alias("blocker"))


@query(r"""WITH d AS (SELECT page_id, regexp_matches(html, '(?i)<input[^>]+type=["'']?password') AS form, 200 + 50 * (page_id % 5) AS status, regexp_matches(html, '(?i)buy this domain|domain (?:is )?for sale|parkingcrew|sedoparking') AS parked, length(html) % 7 AS last, length(html) % 3 AS per FROM pages)
SELECT page_id, CASE WHEN parked THEN '후보-OFFLINE(도메인 파킹, 사람 확인 필요) (파킹 페이지 키워드 매칭 · 2026-01-02)' WHEN status < 300 THEN 'online (직접 접속 · 2026-01-02)' ELSE '못 봄(응답 코드 ' || status || ')' END AS state,
    CASE WHEN form THEN 'true (로그인 폼 존재 여부 · 2026-01-02)' ELSE '못 봄(로그인 폼이 안 보입니다. 가입이 필요 없다는 뜻은 아닙니다)' END AS signup,
    CASE WHEN last * per > 0 THEN '추정: 추정 약 ' || last * per || '건 (마지막 페이지 ' || last || ' × 페이지당 ' || per || '건) (페이지네이션 추정 — 정확한 통계 아님 · 2026-01-02)' ELSE '못 봄(페이지네이션 숫자 파싱 실패)' END AS size FROM d""")
def web_states(spark, sf_dir):
    """Each value is written as JSON, read back and rendered."""
    page, day = F.col("html"), F.lit("2026-01-02")
    pager = F.concat(F.lit('<a href="?page=9">'), (F.length(page) % 7).cast("string"), F.lit("</a>"))
    found = {"state": webpages.availability(200 + 50 * (F.col("page_id") % 5), page, day), "signup": webpages.signup_needed(page, day), "size": webpages.size_estimate(webpages.last_page(pager), F.length(page) % 3, day)}
    values = table(spark, sf_dir, "pages").select("page_id", *[v.alias(n) for n, v in found.items()])
    stored = values.select("page_id", *[states.encoded(F.col(n)).alias(n) for n in found])
    return stored.select("page_id", *[states.rendered(states.decoded(F.col(n))).alias(n) for n in found])
