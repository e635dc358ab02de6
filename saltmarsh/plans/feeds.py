"""Queries: feeds, dumps, trees and thread files, written from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.plans.registry import query, table
from saltmarsh.sources import dumps, feeds, sinks


@query("""SELECT o_orderkey, 'cust' || o_custkey AS victim, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS state FROM orders WHERE o_orderkey % 4 <> 3""")
def src_feed_shapes(spark, sf_dir):
    k = F.col("o_orderkey")
    entry = F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("cust"), "o_custkey")).alias("victim"), F.when(k % 2 == 1, F.concat(F.lit("cust"), "o_custkey")).alias("name"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("state")))
    body = F.when(k % 4 == 0, F.concat(F.lit("["), entry, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit('{"victims": ['), entry, F.lit("]}")))
    body = body.when(k % 4 == 2, F.concat(F.lit('{"data": ['), entry, F.lit("]}"))).otherwise(F.concat(entry, F.lit("broken")))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return feeds.feed_rows(raw, "body", {"victim": ("victim", "name"), "state": ("state",)}, ("o_orderkey",))


@query("SELECT 'c' || conv_id AS channel, turn AS id, text FROM conversations")
def src_channel_payload(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("id"), "text")).alias("messages"))
    raw = talks.select(F.to_json(F.struct(F.struct(F.concat(F.lit("c"), "conv_id").alias("id")).alias("channel"), "messages")).alias("body"))
    return feeds.channel_messages(raw, "body").select("channel", "id", "text")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '!' WHEN 1 THEN lang WHEN 2 THEN lang || ',' || source WHEN 3 THEN CAST(n_chars AS VARCHAR) WHEN 4 THEN '2026-01-02' END AS value FROM documents""")
def src_tagged_property(spark, sf_dir):
    k, lang, source = F.col("doc_id") % 6, F.col("lang"), F.col("source")
    prop = F.when(k == 0, F.format_string('{"type": "title", "title": [{"plain_text": "%s"}, {"plain_text": "!"}]}', source))
    prop = prop.when(k == 1, F.format_string('{"type": "select", "select": {"name": "%s"}}', lang))
    prop = prop.when(k == 2, F.format_string('{"type": "multi_select", "multi_select": [{"name": "%s"}, {"name": "%s"}]}', lang, source))
    prop = prop.when(k == 3, F.format_string('{"type": "number", "number": %s}', F.col("n_chars").cast("string")))
    prop = prop.when(k == 4, F.lit('{"type": "date", "date": {"start": "2026-01-02"}}')).otherwise(F.lit('{"type": "select", "select": null}'))
    return table(spark, sf_dir, "documents").select("doc_id", feeds.property_text(F.try_parse_json(prop)).alias("value"))


@query("SELECT c_custkey, 'Acme' AS account, 1900000000000000000 + c_custkey * 4194304000 AS number, epoch_ms((1900000000000000000 + c_custkey * 4194304000) // 4194304 + 1288834974657) AS at, c_name AS text FROM customer")
def src_profile_posts(spark, sf_dir):
    number = F.lit(1900000000000000000) + F.col("c_custkey") * 4194304000
    content = F.concat(F.lit("header\n*   "), "c_name", F.lit(" https://x.com/acme/status/"), number.cast("string"), F.lit("/photo/1\n*   other https://x.com/else/status/1234567"))
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.lit("Acme").alias("account"), content.alias("content"))
    posts = feeds.profile_posts(pages, "account", "content")
    return posts.join(pages.select("c_custkey", (F.lit(1900000000000000000) + F.col("c_custkey") * 4194304000).alias("number")), "number").select("c_custkey", "account", "number", F.col("at").cast("timestamp_ntz").alias("at"), "text")


@query("SELECT page_id, 'page ' || page_id AS title, url AS link FROM pages")
def src_rss_item(spark, sf_dir):
    xml = F.concat(F.lit("<item><title>page "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    return table(spark, sf_dir, "pages").select("page_id", feeds.rss_item(xml).alias("i")).select("page_id", "i.title", "i.link")


@query("SELECT c_nationkey AS file, c_custkey AS number, ([',', chr(9), '|', ';', ':'])[c_nationkey % 5 + 1] AS delimiter, c_name AS name, c_mktsegment AS segment FROM customer")
def src_delimited(spark, sf_dir):
    k = F.col("c_nationkey") % 5
    mark = F.when(k == 0, ",").when(k == 1, "\t").when(k == 2, "|").when(k == 3, ";").otherwise(":")
    line = F.concat_ws("", F.col("c_custkey").cast("string"), mark, F.lit('"'), "c_name", F.lit('"'), mark, "c_mktsegment")
    lines = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("number"), line.alias("line"))
    found = dumps.delimited(lines, "file", "number", "line", sample=1 << 40)
    return found.select("file", "number", "delimiter", F.get("values", F.lit(1)).alias("name"), F.get("values", F.lit(2)).alias("segment"))


@query("""SELECT 'users' AS name, 'id|name|note' AS columns, CAST(c_custkey AS VARCHAR) AS id, c_name || '''s, (x)' AS owner, 'NULL' AS note FROM customer
UNION ALL SELECT 'db.raw', NULL, CAST(s_suppkey AS VARCHAR), s_name, '' FROM supplier""")
def src_insert_dump(spark, sf_dir):
    # A statement holds up to 15,000 keys of a nation, as a dump's do, however many customers there are.
    some = lambda key: F.floor(F.col(key) / 15_000)
    users = table(spark, sf_dir, "customer").groupBy("c_nationkey", some("c_custkey")).agg(F.array_join(F.collect_list(F.format_string("(%d, '%s''s, (x)', NULL)", "c_custkey", "c_name")), ",\n").alias("t"))
    raw = table(spark, sf_dir, "supplier").groupBy("s_nationkey", some("s_suppkey")).agg(F.array_join(F.collect_list(F.format_string("(%d,'%s','')", "s_suppkey", "s_name")), ",").alias("t"))
    said = users.select(F.concat(F.lit('INSERT INTO `users` (`id`, "name", note) VALUES '), "t").alias("s")).unionByName(raw.select(F.concat(F.lit("insert into db.raw values"), "t").alias("s")))
    found = dumps.insert_rows(said.unionByName(users.select(F.lit("CREATE TABLE x (id int)").alias("s"))), "s")
    return found.select("name", F.array_join("columns", "|").alias("columns"), *[F.get("values", F.lit(k)).alias(n) for k, n in enumerate(("id", "owner", "note"))])


@query("""SELECT n_regionkey AS file, r_name || '/' || n_name || coalesce('/' || s_name, '') AS path
FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def src_tree_paths(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    zero = F.lit(0).cast("long")
    lines = (
        table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file"), zero.alias("number"), F.concat(F.lit("└── "), "r_name").alias("line"))
        .unionByName(nation.select(F.col("n_regionkey").alias("file"), ((F.col("n_nationkey").cast("long") + 1) * 1_000_000_000).alias("number"), F.concat(F.lit("    ├── "), "n_name", F.lit("/")).alias("line")))
        .unionByName(table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_regionkey").alias("file"), ((F.col("n_nationkey").cast("long") + 1) * 1_000_000_000 + 1 + F.col("s_suppkey")).alias("number"), F.concat(F.lit("    │   └── "), "s_name").alias("line")))
    )
    return dumps.tree_paths(lines, "file", "number", "line").select("file", "path")


@query(r"""WITH posts AS (SELECT conv_id AS file, 'conv ' || conv_id AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS post, role, coalesce(text, '') AS text FROM conversations)
SELECT file, title, post, CASE WHEN post = 1 THEN '원문' ELSE '답글 ' || post END AS label, role AS author,
    array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') NOT IN ('', '```')), chr(10)) AS body FROM posts""")
def src_thread_posts(spark, sf_dir):
    by = F.struct("turn", "role", "text")
    posts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(by)).alias("posts"))
    head = lambda k: F.when(k == 0, F.lit("### 원문 ")).otherwise(F.concat(F.lit("### 답글 "), (k + 1).cast("string"), F.lit(" ")))
    told = F.transform("posts", lambda p, k: F.concat(head(k), p.role, F.lit(" at some time\n"), F.coalesce(p.text, F.lit(""))))
    text = F.concat(F.lit("kit\n## conv "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(told, "\n"))
    lines = posts.select(F.col("conv_id").alias("file"), F.posexplode(F.split(text, "\n")).alias("number", "line"))
    return dumps.thread_posts(lines, "file", "number", "line").select("file", "title", F.col("post").cast("long").alias("post"), "label", "author", "body")


@query("SELECT 'url' AS column, count(*) AS n FROM pages WHERE page_id % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'more', count(*) FROM pages WHERE page_id % 5 = 0 HAVING count(*) > 0")
def snk_gate(spark, sf_dir):
    k = F.col("page_id")
    more = F.array(F.struct(F.lit("fine").alias("a"), F.when(k % 5 == 0, "see T.me/x").otherwise("none").alias("b")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, F.concat(F.lit("http://abc.onion/"), k.cast("string"))).otherwise("https://a.b/").alias("url"), more.alias("more"))
    return sinks.violations(rows)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)")
def snk_new_cases(spark, sf_dir):
    queued = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.new_cases(table(spark, sf_dir, "orders"), queued, "o_custkey").select("o_orderkey")
