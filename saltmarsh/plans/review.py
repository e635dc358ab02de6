"""Queries: review and publication, differences of tables, slices, budgets, and the guide."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from saltmarsh.functions import review as words
from saltmarsh.operators import review
from saltmarsh.plans.registry import query, table

#: Weight of each leaked item for each risk (fixed values).
WEIGHTS = (
    ("account", "acct", 3), ("account", "money", 1), ("email", "acct", 1), ("email", "phish", 2), ("phone", "acct", 1), ("phone", "phish", 2),
    ("name", "phish", 1), ("address", "phish", 1), ("rrn", "ident", 3), ("rrn", "money", 3), ("finance", "money", 3), ("internal", "priv", 2),
)
ITEMS = ("account", "email", "phone", "name", "address", "rrn", "finance", "internal", "etc")


def pick(values, column):
    """One of the values by column modulo their number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(column, F.lit(len(values))).cast("int"))


def chosen(values, column):
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[{column} % {len(values)} + 1]"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


STATES = ("사건 O", "사건 X", "미검토", "", None)


@query(f"""SELECT doc_id, CASE WHEN a IN ('사건 X', '미검토') THEN false WHEN a = '사건 O' AND b IN ('미검토', '사건 X') THEN true END AS publish
FROM (SELECT doc_id, {chosen(STATES, 'doc_id')} AS b, {chosen(STATES, '(doc_id // 5)')} AS a FROM documents)""")
def add_publish(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", words.publish(pick(STATES, F.col("doc_id")), pick(STATES, F.floor(F.col("doc_id") / 5))).alias("publish"))


VERDICTS, SURE = ("사건 X", "사건 O", None), ("높음", "중간", "낮음", None)


@query(f"""SELECT doc_id, CASE WHEN v = '사건 X' AND c = '높음' AND r = false THEN '사건 X' ELSE '미검토' END AS alone,
    CASE WHEN v = '사건 X' AND c IN ('높음', '중간') AND r = false THEN '사건 X' ELSE '미검토' END AS attended
FROM (SELECT doc_id, {chosen(VERDICTS, 'doc_id')} AS v, {chosen(SURE, '(doc_id // 3)')} AS c, CASE doc_id // 12 % 3 WHEN 0 THEN false WHEN 1 THEN true END AS r FROM documents)""")
def add_proposal(spark, sf_dir):
    third = F.floor(F.col("doc_id") / 12) % 3
    v, c, r = pick(VERDICTS, F.col("doc_id")), pick(SURE, F.floor(F.col("doc_id") / 3)), F.when(third == 0, False).when(third == 1, True)
    return docs(spark, sf_dir).select("doc_id", words.proposal(v, c, r, True).alias("alone"), words.proposal(v, c, r, False).alias("attended"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '직접' ELSE '미확인' END AS related,
    CASE WHEN doc_id % 6 = 0 THEN 'country only · 소스 country=KR' WHEN doc_id % 6 = 3 THEN '제외어 a · 소스 country=KR · .kr'
        WHEN doc_id % 2 = 0 THEN '소스 country=KR · by hand' ELSE '제외어 a · 소스 country=KR · .kr' END AS reasons FROM documents""")
def add_related(spark, sf_dir):
    tier = F.when(F.col("doc_id") % 3 == 0, "strong").otherwise("review")
    reasons = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("소스 country=KR"))).otherwise(F.array(*map(F.lit, ("제외어 a", "소스 country=KR", ".kr"))))
    return docs(spark, sf_dir).select("doc_id", words.direct(tier).alias("related"), words.reasons_text(tier, reasons, F.col("doc_id") % 2 == 0, "country only", "by hand").alias("reasons"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '집계처 API' WHEN 1 THEN '원 출처' WHEN 2 THEN CASE WHEN source = 'web' THEN '집계처 API' ELSE '원 출처' END ELSE '' END AS origin FROM documents""")
def add_size_origin(spark, sf_dir):
    noted = F.when(F.col("doc_id") % 4 == 0, "집계처 화면").when(F.col("doc_id") % 4 == 1, "페이지").otherwise(" ")
    source = F.when(F.col("doc_id") % 4 == 3, "").when(F.col("source") == "web", "랜섬웨어").otherwise(F.coalesce("source", F.lit("else")))
    return docs(spark, sf_dir).select("doc_id", words.size_origin(noted, source).alias("origin"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' WHEN 2 THEN '압수됨' WHEN 3 THEN 'online' WHEN 4 THEN '압수됨' ELSE '미확인' END AS state FROM documents""")
def add_group_state(spark, sf_dir):
    k = F.col("doc_id") % 6
    up = F.when(k <= 1, False)
    places = F.array(F.struct(up.alias("available"), F.when(k == 2, "This site was SEIZED").alias("title")), F.struct(F.when(k == 0, True).alias("available"), F.lit(None).cast("string").alias("title")))
    fields = [F.when(k == 3, "Up"), F.when(k == 4, "takedown notice").when(k == 0, "offline")]
    return docs(spark, sf_dir).select("doc_id", words.group_state(F.when(k != 5, places), fields).alias("state"))


@query("""SELECT page_id, page_id % 4 <> 3 AS alike FROM pages""")
def add_titles_alike(spark, sf_dir):
    k = F.col("page_id") % 4
    left = F.when(k == 0, "Dark Market Forum").when(k == 1, "Breach").otherwise("Alpha Beta 한국어")
    right = F.when(k == 0, "market - dark - Tor").when(k == 1, "The Breach mirror site").when(k == 2, "beta 한국어 news").otherwise("alpha forum index other")
    return table(spark, sf_dir, "pages").select("page_id", words.titles_alike(left, right).alias("alike"))


#: Link lists, # standing for the row's number, and their entries joined by bars, as told by hand.
LINKS = (
    ("앞선곳:A# (원본, 2022~2023), 텔레그램:X", "앞선곳:A# (원본, 2022~2023)|텔레그램:X"),
    ("포럼 DB: A · 텔레그램 DB: X# · 랜섬웨어 DB: Y", "포럼 DB: A|텔레그램 DB: X#|랜섬웨어 DB: Y"),
    ("앞선곳:A (원본#\n텔레그램:B", "앞선곳:A (원본#|텔레그램:B"),
    ("A (x (y, z), w#), B", "A (x (y, z), w#)|B"),
    ("A (x · y#), B, 없음, -", "A (x · y#)|B"),
    ("A (x, y#); B · ,(C, see\nD", "A (x, y#)|B|(C, see|D"),
    ("a) b, c [d; e#, f] g", "a) b|c [d|e#, f] g"),
    ("n# (" + "long, " * 200 + "end), m", "n# (" + "long, " * 200 + "end)|m"),
    ("", ""),
)


@query(f"""SELECT doc_id, CASE WHEN doc_id = 7 THEN 'LEAK-7' ELSE 'LEAK-' || doc_id || '|LEAK-7' END AS ids,
replace(([{", ".join("'" + told + "'" for _, told in LINKS)}])[doc_id % 9 + 1], '#', doc_id::VARCHAR) AS links, 'v' || doc_id AS bare FROM documents""")
def add_split_lists(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    ids = F.concat(F.lit(" LEAK-"), number, F.lit(" ,LEAK- 7,,LEAK-"), number, F.lit(","))
    said = F.replace(pick([text for text, _ in LINKS], F.col("doc_id")), F.lit("#"), number)
    return docs(spark, sf_dir).select("doc_id", F.array_join(words.evidence_ids(ids), "|").alias("ids"), F.array_join(words.links(said), "|").alias("links"), words.without_date(F.concat(F.lit("v"), number, F.lit(" (2026-01-02)"))).alias("bare"))


NAMES = ("https://t.me/Chan_One", "@chan_one", "t.me/s/CHAN_ONE?x=1", "https://t.me/+abcdef", "t.me/joinchat/xyz", "ab", None)


@query("SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN 'chan_one' END AS channel FROM documents")
def add_channel_name(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", words.channel_name(pick(NAMES, F.col("doc_id"))).alias("channel"))


@query("SELECT page_id, 'a <b>c</b> d' AS bare FROM pages")
def add_strip_active(spark, sf_dir):
    said = F.concat(F.lit("a <script>x("), F.col("page_id").cast("string"), F.lit(")</script\n><b onclick='y()' onload=z>c</b> javascript:d<iframe src=q>"))
    return table(spark, sf_dir, "pages").select("page_id", words.without_active(said).alias("bare"))


@query("SELECT o_orderkey, CASE WHEN coalesce(o_orderkey % 5, -1) > o_orderkey % 7 THEN 'supply' ELSE 'direct' END AS axis FROM orders")
def add_higher_axis(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", words.higher_axis(k % 7, k % 5, "direct", "supply").alias("axis"))


@query("""WITH judged AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 10 = 1 UNION ALL SELECT -doc_id - 1, 1 FROM labels WHERE doc_id % 9 = 0),
each AS (SELECT doc_id, count(*) AS n, bool_and(coalesce(quality = 1, false)) AS fine FROM judged GROUP BY doc_id)
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN fine THEN 'valid' ELSE 'invalid' END AS status
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN each USING (doc_id)""")
def add_reconciled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("verdict"))
    extra = labels.where(F.col("doc_id") % 9 == 0).select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("1").alias("verdict"))
    judged = labels.where(F.col("doc_id") % 3 != 0).unionByName(labels.where(F.col("doc_id") % 10 == 1)).unionByName(extra)
    return review.reconciled(labels, judged, "doc_id", {"verdict": ("1",)})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'gone' WHEN o_orderstatus = 'F' THEN 'same' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'apply' END AS status,
    CASE WHEN o_orderkey % 13 <> 0 AND (o_orderstatus = 'F' OR o_orderkey % 3 <> 0) THEN 'F' WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS after FROM orders""")
def add_guarded_changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    plan = orders.select("o_orderkey", F.when(k % 3 == 0, "?").otherwise(F.col("o_orderstatus")).alias("seen"), F.lit("F").alias("new"))
    there = orders.where(k % 13 != 0)
    changes = review.guarded_changes(plan, there, "o_orderkey", "o_orderstatus")
    after = review.applied(there, changes, "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "after")
    return changes.select("o_orderkey", "status").join(after, "o_orderkey", "left")


@query("""WITH a AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 6 = 0 THEN source || '+' ELSE source END AS source FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, 'left' AS what FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT doc_id, 'right' FROM b ANTI JOIN a USING (doc_id)
UNION ALL SELECT a.doc_id, 'lang' FROM a JOIN b USING (doc_id) WHERE a.lang IS DISTINCT FROM b.lang UNION ALL SELECT a.doc_id, 'source' FROM a JOIN b USING (doc_id) WHERE a.source IS DISTINCT FROM b.source""")
def add_row_differences(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang", "source")
    other = rows.where(F.col("doc_id") % 11 != 0).select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 6 == 0, F.concat("source", F.lit("+"))).otherwise(F.col("source")).alias("source"))
    return review.row_differences(rows.where(F.col("doc_id") % 10 != 0), other, "doc_id", ["lang", "source"])


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id HAVING count(*) > 1")
def add_conflicting(spark, sf_dir):
    return review.conflicting(table(spark, sf_dir, "events"), "user_id", ["event_type"])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN lang WHEN doc_id % 5 <> 4 THEN 'new' WHEN doc_id % 3 = 0 THEN '없음 yet' ELSE '' END AS lang,
    CASE WHEN doc_id % 3 = 1 AND doc_id % 5 <> 4 AND lang <> 'new' THEN 'lang' ELSE '' END AS conflicts FROM documents""")
def add_blanks_filled(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("lang")).when(F.col("doc_id") % 3 == 0, "없음 yet").otherwise("").alias("lang"))
    found = docs(spark, sf_dir).where(F.col("doc_id") % 5 != 4).select("doc_id", F.lit("new").alias("lang"))
    return review.blanks_filled(rows, found, "doc_id", ["lang"], "없음").select("doc_id", "lang", F.array_join("conflicts", ",").alias("conflicts"))


@query("""WITH named AS (SELECT o_custkey, 'n' || o_orderkey % 50 AS name FROM orders), places AS (SELECT 'n' || c_custkey % 50 AS name, c_custkey % 10 AS place FROM customer)
SELECT o_custkey, min(place) AS place FROM named JOIN places USING (name) GROUP BY o_custkey HAVING count(DISTINCT place) = 1""")
def add_unique_place(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("n"), (F.col("o_orderkey") % 50).cast("string")).alias("name"))
    places = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), (F.col("c_custkey") % 50).cast("string")).alias("name"), (F.col("c_custkey") % 10).alias("place"))
    return review.unique_place(named, "o_custkey", places.distinct(), "name", "place")


@query("""WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, (place - 1400 % n + n) % n AS turn FROM k WHERE (place - 1400 % n + n) % n < 300""")
def add_round_robin(spark, sf_dir):
    return review.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1400, 300)


@query("""SELECT round(coalesce(sum(value) FILTER (ts::DATE = DATE '2024-01-02'), 0), 6) AS spent, round(coalesce(sum(value) FILTER (ts::DATE = DATE '2024-01-02'), 0), 6) + 1.5 <= 100 AS allowed FROM events""")
def add_budget(spark, sf_dir):
    return review.budget_left(table(spark, sf_dir, "events"), F.to_date("ts"), "value", F.lit(datetime.date(2024, 1, 2)), 100.0, 1.5)


@query("SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type <> 'error') >= 0.5 * count(*) AND max(value) <= 1e9 AS passed FROM events")
def add_quality_gate(spark, sf_dir):
    return review.quality_gate(table(spark, sf_dir, "events"), F.col("event_type") != "error", F.col("value"), 0.5, 1e9)


def leaked(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), pick(ITEMS, F.col("o_orderkey")).alias("item"))


def levels(spark, sf_dir):
    return review.risk_levels(leaked(spark, sf_dir), spark.createDataFrame(list(WEIGHTS), "item string, risk string, weight int"))


LEVELS = f"""WITH leaked AS (SELECT DISTINCT o_custkey AS "case", {chosen(ITEMS, 'o_orderkey')} AS item FROM orders),
weights(item, risk, weight) AS (VALUES {', '.join(str(w) for w in WEIGHTS)}),
has AS (SELECT "case", bool_or(item = 'name') AS name, bool_or(item = 'phone') AS phone, bool_or(item = 'rrn') AS rrn FROM leaked GROUP BY "case"),
levels AS (SELECT "case", risk, max(CASE WHEN risk = 'phish' AND name AND phone THEN least(w + 1, 3) WHEN risk = 'ident' AND name AND rrn THEN 3 ELSE w END) AS level
    FROM (SELECT "case", risk, max(weight) AS w FROM leaked JOIN weights USING (item) GROUP BY ALL) JOIN has USING ("case") GROUP BY ALL)"""


@query(f'{LEVELS} SELECT "case", risk, level FROM levels')
def guide_levels(spark, sf_dir):
    return levels(spark, sf_dir)


#: The nations are the guide's actions.
GUIDE_SQL = f"""{LEVELS}, actions AS (SELECT n_nationkey AS action, (['acct', 'phish', 'money', 'ident', 'priv'])[n_nationkey % 5 + 1] AS risk, n_nationkey % 3 AS urgency, [{chosen(ITEMS, 'n_nationkey')}, {chosen(ITEMS, '(n_nationkey // 2)')}] AS need FROM nation),
met AS (SELECT DISTINCT "case", action, risk, urgency FROM leaked JOIN actions ON list_contains(need, item) JOIN levels USING ("case", risk)),
picked AS (SELECT "case", action, row_number() OVER (PARTITION BY "case" ORDER BY urgency, list_position(CASE WHEN "case" % 2 = 0 THEN ['money', 'ident', 'acct', 'phish', 'priv'] ELSE ['acct', 'phish', 'money', 'ident', 'priv'] END, risk), action) AS place FROM met)"""


def picked(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    actions = table(spark, sf_dir, "nation").select(k.alias("action"), pick(("acct", "phish", "money", "ident", "priv"), k).alias("risk"), (k % 3).alias("urgency"), F.array(pick(ITEMS, k), pick(ITEMS, F.floor(k / 2))).alias("need"))
    orders = F.when(F.col("case") % 2 == 0, F.array(*map(F.lit, ("money", "ident", "acct", "phish", "priv")))).otherwise(F.array(*map(F.lit, ("acct", "phish", "money", "ident", "priv"))))
    priority = leaked(spark, sf_dir).select("case").distinct().select("case", orders.alias("order"))
    return review.picked_actions(leaked(spark, sf_dir), levels(spark, sf_dir), actions, priority)


@query(f'{GUIDE_SQL} SELECT "case", action, place FROM picked')
def guide_actions(spark, sf_dir):
    return picked(spark, sf_dir).withColumn("place", F.col("place").cast("long"))


@query(f"""{GUIDE_SQL}, marked AS (SELECT *, (action + "case") % 4 = 0 AS done, (action + "case") % 4 = 1 AS later FROM picked)
SELECT "case", arg_min(action, place + CASE WHEN later THEN 1000 ELSE 0 END) FILTER (NOT done) AS next, count(*) + 2 AS total, count(*) FILTER (done) + 2 AS finished FROM marked GROUP BY "case\"""")
def guide_progress(spark, sf_dir):
    found = picked(spark, sf_dir)
    k = (F.col("action") + F.col("case")) % 4
    marks = found.where(k <= 1).select("case", "action", F.when(k == 0, "done").otherwise("later").alias("mark"))
    return review.next_actions(found, marks)
