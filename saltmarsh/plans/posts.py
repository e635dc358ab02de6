"""Queries: posts of four shapes made of the documents' own words, read as items; shapes of tables in dumps; grades of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import posts, profile
from saltmarsh.plans.registry import query, table
from saltmarsh.sources import dumps

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(r"""WITH w AS (SELECT doc_id, doc_id % 6 AS k, lang, coalesce(text, '') AS text, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents),
n AS (SELECT *, w[1] AS a, w[2] AS b, w[3] AS c FROM w WHERE len(w) > 2)
SELECT doc_id, CASE k WHEN 0 THEN 'JSON' WHEN 1 THEN 'JSON(깨짐)' WHEN 2 THEN '글자만' WHEN 3 THEN '라벨' ELSE '글자만' END AS shape, k = 2 AS cut_off,
    CASE k WHEN 0 THEN '랜섬 피해자' WHEN 1 THEN '유출 알림' WHEN 3 THEN '유출 알림' ELSE '기타' END AS post_kind,
    CASE k WHEN 0 THEN a || ' ' || b WHEN 1 THEN a WHEN 3 THEN a || ' ' || b WHEN 4 THEN a || ' ' || b WHEN 5 THEN a || '.' || b || '.kr' ELSE '' END AS org,
    CASE k WHEN 0 THEN '칸' WHEN 1 THEN '칸' WHEN 3 THEN '칸' WHEN 4 THEN '제목(속보 꼴)' WHEN 5 THEN '본문 한국 도메인' ELSE '' END AS org_from,
    CASE k WHEN 0 THEN upper(lang) WHEN 4 THEN 'FR' ELSE '' END AS country, CASE k WHEN 0 THEN c WHEN 3 THEN c ELSE '' END AS actor,
    CASE k WHEN 0 THEN a || '.com' WHEN 3 THEN b || '.example' ELSE 't.me/' || lang END AS venue,
    CASE k WHEN 0 THEN 'forum' WHEN 3 THEN 'forum' ELSE 'telegram' END AS venue_kind,
    CASE k WHEN 0 THEN (a || ' ' || b)[:120] WHEN 1 THEN (a || ' ' || b)[:120] WHEN 2 THEN '{"Type": "data leak",' WHEN 3 THEN (a || ' ' || b)[:120] WHEN 4 THEN ('🚨🇫🇷 ' || a || ' ' || b || ' customer data allegedly leaked')[:120] ELSE ('at ' || a || '.' || b || '.kr now')[:120] END AS title
FROM n""")
def src_post_items(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 6).alias("k"), words.alias("w")).where(F.size("w") > 2)
    a, b, c = (F.col("w")[k] for k in range(3))
    say = lambda form, *parts: F.format_string(form, *parts)
    text = F.when(F.col("k") == 0, say('from the channel\n{"Type": " Ransomware", "Victim": "👤 %s %s", "Group": " (%s)", "Country": "%s", "Source": "%s[.]com", "Rows": 5, "Note": null}', a, b, c, F.upper("lang"), a))
    text = text.when(F.col("k") == 1, say('{\n"Type": "data leak",\n"Content": "%s <a href="x">%s</a>",\n"Victim": "%s",\n}', a, b, a))
    text = text.when(F.col("k") == 2, say('{"Type": "data leak",\n"Victim": "%s"', a))
    text = text.when(F.col("k") == 3, say("• Target/Title: %s %s\n- Threat Actor: 👤 %s\nSize: 5GB\nsee hxxps://t.me/x https://%s[.]example/p).", a, b, c, b))
    text = text.when(F.col("k") == 4, say("🚨🇫🇷 %s %s customer data allegedly leaked\nmore", a, b)).otherwise(say("at %s.%s.kr now", a, b))
    links = F.when(F.col("k") == 3, F.array(F.lit("https://t.me/x"), F.concat(F.lit("https://"), b, F.lit("[.]example/p"))))
    found = posts.post_items(rows.select("doc_id", F.col("lang").alias("channel"), text.alias("text"), links.alias("links")))
    return found.select("doc_id", "shape", (F.col("note") == "중괄호로 시작하는데 닫히지 않았다. 글이 잘렸을 수 있다").alias("cut_off"), "post_kind", "org", "org_from", "country", "actor", "venue", "venue_kind", "title")


@query("""SELECT n_nationkey AS file, lower(replace(n_name, ' ', '_')) AS name, 'id|name|kind' AS columns, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_tuples FROM nation
UNION ALL SELECT s_nationkey, 'db.raw', 'key|label', count(*) FROM supplier GROUP BY s_nationkey UNION ALL SELECT c_nationkey, 'bare', '', count(*) FROM customer WHERE c_custkey % 5 = 0 GROUP BY c_nationkey""")
def src_table_shapes(spark, sf_dir):
    """Definitions with brackets, commas and quotes in them; one INSERT a customer; lists a supplier; and INSERTs without columns."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    ddl = F.concat(F.lit("CREATE TABLE IF NOT EXISTS `"), name, F.lit("` (`id` decimal(10,2) NOT NULL, name varchar(20) DEFAULT 'a,(b' COMMENT 'x, y)', \"kind\" enum('a','b(c'), PRIMARY KEY (`id`, name), KEY k (name(10)))"))
    said = nation.select(F.col("n_nationkey").alias("file"), ddl.alias("s"))
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("file"), F.concat(F.lit("INSERT INTO "), name, F.lit(" (a, b) VALUES ("), F.col("c_custkey").cast("string"), F.lit(", 'x), ("), "c_name", F.lit("')")).alias("s"))
    bare = customer.where("c_custkey % 5 = 0").select(F.col("c_nationkey").alias("file"), F.concat(F.lit("insert into bare values (1, '"), "c_name", F.lit("')")).alias("s"))
    listed = supplier.groupBy("s_nationkey").agg(F.array_join(F.collect_list(F.format_string("\n(%d,'%s')", "s_suppkey", "s_name")), ",").alias("t")).select(F.col("s_nationkey").alias("file"), F.concat(F.lit("INSERT INTO db.raw (key, `label`) VALUES"), "t").alias("s"))
    found = dumps.table_shapes(said.unionByName(people).unionByName(bare).unionByName(listed), "s", "file")
    return found.select("file", "name", F.array_join("columns", "|").alias("columns"), "n_tuples")


@query("""WITH c AS (SELECT table_name AS "table", column_name AS c FROM information_schema.columns WHERE table_name IN ('%s')),
k AS (SELECT "table", CASE %s END AS kind FROM c),
g AS (SELECT "table", coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds FROM k GROUP BY "table")
SELECT "table", kinds, CASE WHEN contains(kinds, 'ident') OR contains(kinds, 'login') THEN '치명' WHEN (contains(kinds, 'money') OR contains(kinds, 'contact')) AND contains(kinds, 'name') THEN '높음'
    WHEN contains(kinds, 'money') OR contains(kinds, 'contact') THEN '중간' ELSE '낮음' END AS grade FROM g""" % ("', '".join(TABLES), " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{k}'" for k, p in profile.SENSITIVE.items())))
def prof_table_grade(spark, sf_dir):
    """Tables and columns as their files describe them."""
    found = [(t, c) for t in TABLES for c in table(spark, sf_dir, t).columns]
    return profile.table_grades(spark.createDataFrame(found, "table string, column string"))
