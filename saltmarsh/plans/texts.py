"""Queries: text keys, masking, sizes and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import classify, sizes, text, times
from saltmarsh.plans.canonical import ITEMS_SQL, items
from saltmarsh.plans.registry import query, table

ITEMS = f"WITH {ITEMS_SQL}"


@query(r"""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':.*$', ''),
    '((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})', 1), '^www\.', '') AS domain FROM pages""")
def text_extract_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query("SELECT page_id, replace(regexp_replace(regexp_replace(url, '^https://', 'hxxps://'), '^http://', 'hxxp://'), '.', '[.]') AS url FROM pages")
def text_defang(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.defanged_url(F.col("url")).alias("url"))


@query("SELECT page_id, url FROM pages")
def text_refang(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.refanged(text.defanged_url(F.col("url"))).alias("url"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g') AS key, replace(regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g'), '0', 'o') AS handle FROM documents")
def text_bare_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.bare_key(F.col("text")).alias("key"), text.handle_key(F.col("text")).alias("handle"))


@query()
def text_norm_key(spark, sf_dir):
    """DuckDB has no compatibility form, so there is no SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", text.name_key(F.col("text")).alias("key"))


@query()
def text_pii_mask(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.personal_masked(F.col("text")).alias("found"))
    return docs.select("doc_id", "found.masked", F.array_join("found.labels", ",").alias("labels"))


@query(r"""SELECT doc_id, length(text) - length(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+', '', 'g')) > 0 AS has_mail FROM documents""")
def text_mail_found(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(text.personal_labels(F.col("text")), "[이메일]").alias("has_mail"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?:https?|hxxps?|ftp)://\S+', '(주소 가림)', 'gi'), '\bt\.me/\S+', '(주소 가림)', 'gi'),
    '\b[a-z2-7]{56}\b(?:\s*[.\[\]]*\s*onio\W?n\b)?', '(주소 가림)', 'gi'), '\b[a-z0-9.-]+\.onion\b', '(주소 가림)', 'gi') AS t FROM (SELECT doc_id, text || ' http://a.b/c, t.me/x' || doc_id AS text FROM documents))
SELECT doc_id, trim(regexp_replace(t, '(?:\(주소 가림\)[\s,·/]*){2,}', '(주소 가림) ', 'g'), ' ') AS masked FROM m""")
def text_mask_address(spark, sf_dir):
    longer = F.concat(F.col("text"), F.lit(" http://a.b/c, t.me/x"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.masked_addresses(longer).alias("masked"))


@query("""WITH t AS (SELECT doc_id, ([' korea', 'KR', 'South  Korea.', 'North Korea', 'Turkey', '한국', '', NULL, 'de'])[doc_id % 9 + 1] AS name FROM documents)
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'KR' WHEN 1 THEN 'KR' WHEN 2 THEN 'KR' WHEN 3 THEN 'KP' WHEN 4 THEN 'TURKEY' WHEN 5 THEN 'KR' WHEN 8 THEN 'DE' ELSE '' END AS country FROM t""")
def text_country_norm(spark, sf_dir):
    names = F.array(*map(F.lit, [" korea", "KR", "South  Korea.", "North Korea", "Turkey", "한국", "", None, "de"]))
    return table(spark, sf_dir, "documents").select("doc_id", text.country(F.get(names, (F.col("doc_id") % 9).cast("int"))).alias("country"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 19 * 86400 + 7 * 3600 WHEN 1 THEN 9 * 86400 + 3 * 3600 + 14 * 60 + 37 WHEN 2 THEN 9 * 86400 + 3 * 3600 WHEN 3 THEN 9 * 86400 + 3 * 3600 + 14 * 60 + 37
    WHEN 4 THEN 3 * 3600 + 14 * 60 + 37 END::BIGINT AS seconds FROM documents""")
def text_countdown(spark, sf_dir):
    shown = F.array(*map(F.lit, ["19일 7시간", "9일 3시간 14분 37초", "9 days 3 hours", "9d 03:14:37", "03:14:37", "만료", ""]))
    return table(spark, sf_dir, "documents").select("doc_id", times.countdown_seconds(F.get(shown, (F.col("doc_id") % 7).cast("int"))).alias("seconds"))


@query(f"""{ITEMS} SELECT uid, CASE WHEN doc_id % 5 = 3 THEN 'medium' WHEN doc_id % 5 <> 4 THEN 'unknown' WHEN n_chars * 100 >= 1000000 THEN 'large' WHEN n_chars * 100 >= 100000 THEN 'medium' WHEN n_chars > 0 THEN 'small' ELSE 'unknown' END AS grade,
    CASE WHEN doc_id % 5 = 4 AND n_chars > 0 THEN (n_chars * 100)::DOUBLE WHEN doc_id % 5 = 4 THEN 0.0 END AS n_rows FROM items""")
def text_size_parse(spark, sf_dir):
    claim = F.regexp_replace("claimed_size", " rows", "00 rows")
    return items(spark, sf_dir).select("uid", sizes.grade(claim).alias("grade"), sizes.rows_claimed(claim).alias("n_rows"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '을' ELSE '를' END AS particle FROM documents")
def text_particle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.particle(F.when(F.col("doc_id") % 3 == 0, "책").when(F.col("doc_id") % 3 == 1, "나무").otherwise("a"), "을", "를").alias("particle"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^가-힣]', '', 'g')) AS ko FROM documents""")
def text_scripts(spark, sf_dir):
    shares = table(spark, sf_dir, "documents").select("doc_id", text.script_shares(F.col("text")).alias("s"))
    return shares.select("doc_id", "s.latin", "s.ko")


SAID = "url || ' see t.me/ch' || page_id % 5 || ' and t.me/ch1'"


@query(rf"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all({SAID}, 'https?://[^\s<>"'']+') || regexp_extract_all({SAID}, '\bt\.me/[A-Za-z0-9_]+'))), '|') AS mentions FROM pages""")
def text_mentions(spark, sf_dir):
    said = F.concat(F.col("url"), F.lit(" see t.me/ch"), (F.col("page_id") % 5).cast("string"), F.lit(" and t.me/ch1"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.mentions(said), "|").alias("mentions"))


@query("SELECT doc_id, 'LEAK-' || doc_id || ',INC-7' AS cases FROM documents")
def text_case_ids(spark, sf_dir):
    said = F.concat(F.lit("see leak-"), F.col("doc_id").cast("string"), F.lit(", INC-7, Leak-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.case_ids(said), ",").alias("cases"))


@query("""WITH n AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 1000000000000)::VARCHAR, 12, '0') AS d FROM orders), s AS (
    SELECT *, list_sum(list_transform(range(1, 13), lambda k: substr(d, k, 1)::INT * ([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])[k]))::INT AS total FROM n)
SELECT o_orderkey, (11 - total % 11) % 10 = o_orderkey % 10 AS ok FROM s""")
def prof_rrn_checksum(spark, sf_dir):
    key = F.col("o_orderkey")
    digits = F.concat(F.lpad((key * 7919 % 1000000000000).cast("string"), 12, "0"), (key % 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.checksum_ok(digits).alias("ok"))


CLAIMS = [
    ("Samsung Electronics", "samsung.com", "", "big dump", "US"),
    ("Acme", "acme.co.kr", "", "", ""),
    ("Acme", "acme.com", "", "customers in Seoul", "US"),
    ("Nokia Motors", "nokia.fi", "", "", "FI"),
    ("North Korea Trade", "", "", "", ""),
    ("Busan Port", "", "", "", ""),
    ("삼양", "", "", "", ""),
    ("Plain", "plain.org", "", "data", "Korea"),
    ("Foo Korea Ltd", "foo.com", "", "", "DE"),
    ("Fortinet", "fortinet.com", "", "", "US"),
    ("Bits", "bits.net", "managed services", "", "FR"),
    ("Pyongyang Tours", "", "", "", "KP"),
]
KR_EXPECTED = ["likely", "strong", "review", "none", "none", "likely", "likely", "confirmed", "likely", "none", "none", "none"]
SUPPLY_EXPECTED = ["none", "none", "none", "none", "none", "none", "none", "none", "korea_ops", "critical", "sector", "none"]
VENDORS = {"network": ["fortinet", "ivanti"], "files": ["moveit"]}


def claims(spark, sf_dir):
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("victim", "website", "sector", "description", "nation"), c, strict=True)]) for c in CLAIMS])
    return table(spark, sf_dir, "documents").select("doc_id", F.get(rows, (F.col("doc_id") % len(CLAIMS)).cast("int")).alias("c")).select("doc_id", "c.*")


def expected(values: list[str]) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[doc_id % {len(values)} + 1]"


@query(f"SELECT doc_id, {expected(KR_EXPECTED)} AS tier FROM documents")
def cls_kr_tier(spark, sf_dir):
    tier = classify.korea_tier(*map(F.col, ("victim", "website", "sector", "description", "nation")))
    return claims(spark, sf_dir).select("doc_id", tier.alias("tier"))


@query(f"SELECT doc_id, {expected(SUPPLY_EXPECTED)} AS tier FROM documents")
def cls_supply_tier(spark, sf_dir):
    tier = classify.supply_tier(*map(F.col, ("victim", "website", "sector", "description", "nation")), vendors=VENDORS)
    return claims(spark, sf_dir).select("doc_id", tier.alias("tier"))


@query(f"""SELECT doc_id FROM documents WHERE {expected(KR_EXPECTED)} IN ('likely', 'strong', 'confirmed') OR {expected(SUPPLY_EXPECTED)} IN ('critical', 'direct')""")
def flt_two_axis(spark, sf_dir):
    columns = list(map(F.col, ("victim", "website", "sector", "description", "nation")))
    kr, supply = classify.korea_tier(*columns), classify.supply_tier(*columns, vendors=VENDORS)
    return claims(spark, sf_dir).where(classify.meets(kr, "likely", classify.KR_TIERS) | classify.meets(supply, "critical", classify.SUPPLY_TIERS)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE ([true, false, true, true, false, false, false, false, true, true, true, true])[doc_id % 12 + 1] AND {expected(KR_EXPECTED)} NOT IN ('confirmed', 'strong', 'likely') AND doc_id % 12 NOT IN (1, 4, 5, 6)")
def flt_foreign(spark, sf_dir):
    tier = classify.korea_tier(*map(F.col, ("victim", "website", "sector", "description", "nation")))
    return claims(spark, sf_dir).where(classify.foreign(text.country(F.col("nation")), tier)).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'high' WHEN doc_id % 4 = 1 THEN 'medium' ELSE 'low' END AS risk FROM documents")
def cls_risk(spark, sf_dir):
    d = F.col("doc_id")
    exploit = F.when(d % 4 == 0, "가능").when(d % 4 == 1, "조건부").otherwise("불가")
    leaked = F.when(d % 3 == 0, F.array(F.lit("주민번호"), F.lit("이름"))).otherwise(F.array(F.lit("이름")))
    return table(spark, sf_dir, "documents").select("doc_id", classify.risk(exploit, leaked).alias("risk"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'the') AND regexp_matches(lower(text), '(^|[^a-z0-9])(the|and)([^a-z0-9]|$)') THEN CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(the)([^a-z0-9]|$)') THEN 'the' ELSE 'and' END WHEN regexp_matches(lower(text), '(^|[^a-z0-9])and([^a-z0-9]|$)') THEN 'and' END AS term FROM documents")
def cls_first_term(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.first_term(F.lower("text"), ("the", "and")).alias("term"))
