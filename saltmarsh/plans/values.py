"""Queries: single values, keyed fingerprints, grids, identifiers, and cells of several lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions import lines, values
from saltmarsh.plans.registry import query, table
from saltmarsh.plans.review import chosen, pick


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT o_orderkey, round(o_totalprice::VARCHAR::DECIMAL(18, 2), 1)::DOUBLE AS tenth, round(-o_totalprice::VARCHAR::DECIMAL(18, 2), 0)::DOUBLE AS whole FROM orders")
def val_rounded(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.rounded(price, 1).alias("tenth"), values.rounded(-price).alias("whole"))


KEY = "key of the test"
PADS = [''.join(f"\\x{b ^ mask:02X}" for b in KEY.encode().ljust(64, b"\0")) for mask in (0x36, 0x5C)]


def hmac_sql(text):
    return f"sha256('{PADS[1]}'::BLOB || unhex(sha256('{PADS[0]}'::BLOB || encode({text}))))"


@query(f"SELECT doc_id, CASE WHEN text <> '' THEN {hmac_sql('text')} END AS print FROM documents")
def val_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", values.fingerprint(F.col("text"), KEY).alias("print"))


@query(f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
g AS (SELECT conv_id, turn, unnest(w) AS gram FROM w
    UNION ALL SELECT conv_id, turn, unnest([w[k] || w[k + 1] for k in range(1, len(w))]) FROM w WHERE len(w) > 1
    UNION ALL SELECT conv_id, turn, unnest([w[k] || w[k + 1] || w[k + 2] for k in range(1, len(w) - 1)]) FROM w WHERE len(w) > 2)
SELECT DISTINCT conv_id, turn, {hmac_sql('gram')} AS print FROM g WHERE length(gram) >= 2""")
def val_word_fingerprints(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(values.word_fingerprints(words, KEY)).alias("print"))


@query("""SELECT c_custkey, 2 * sqrt(3) * (c_nationkey - 12 + 0.5 * (abs(r) % 2)) AS x, 3.0 * r AS y, c_nationkey - 12 AS back_col, r AS back_row FROM (SELECT *, c_custkey - 70 AS r FROM customer)""")
def val_hex_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") - 12).alias("c"), (F.col("c_custkey") - 70).alias("r"))
    at = values.cell_center(F.col("c"), F.col("r"), 2.0)
    back = values.cell_at(at.x + 0.3, at.y - 0.4, 2.0)  # still nearest to the same middle
    return rows.select("c_custkey", at.x.alias("x"), at.y.alias("y"), back.col.alias("back_col"), back.row.alias("back_row"))


@query("""SELECT c_custkey, cols, greatest(1, ceil(c_custkey / 0.6 / cols) + 2)::BIGINT AS rows FROM (SELECT c_custkey, greatest(1, ceil(sqrt(c_custkey / 0.6 * 1.7)))::BIGINT AS cols FROM customer WHERE c_custkey > 0)
UNION ALL SELECT c_custkey, 1, 1 FROM customer WHERE c_custkey = 0""")
def val_grid_size(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", values.grid_size(F.col("c_custkey")).alias("g")).select("c_custkey", "g.cols", "g.rows")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000 WHEN 2 THEN n_chars * 1000000 + 500000 WHEN 3 THEN (n_chars || '7')::BIGINT END AS number, doc_id % 6 IN (1, 2) AS approximate FROM documents""")
def val_approximate(spark, sf_dir):
    n, k = F.col("n_chars"), F.col("doc_id") % 6
    exact = F.format_number(n, 0)
    said = F.when(k == 0, exact).when(k == 1, F.concat(exact, F.lit(" k"))).when(k == 2, F.concat(n.cast("string"), F.lit(".5M"))).when(k == 3, F.concat(exact, F.lit(" members, 7 online"))).when(k == 4, "1.2.3")
    return docs(spark, sf_dir).select("doc_id", values.approximate_number(said).alias("v")).select("doc_id", "v.number", "v.approximate")


NAMES = ("hxxps://t.me/Chan_#/9", "@CHAN_#", "t.me/chan_#?x=1", "https://www.telegram.me/chan_#/", "https://other.example/chan_#", "ch", None, " /chan_#/ ")


@query("""SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 1, 2, 3, 7) THEN 'chan_' || doc_id END AS name,
    CASE doc_id % 4 WHEN 0 THEN '7' || doc_id || '9000000' WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN '0' END AS number FROM documents""")
def val_channel_ids(spark, sf_dir):
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    number = F.when(k == 0, F.concat(F.lit("-100 7"), n, F.lit("9000000"))).when(k == 1, F.concat(F.lit("00"), n)).when(k == 2, "000").otherwise("1x")
    said = F.replace(pick(NAMES, F.col("doc_id")), F.lit("#"), n)
    return docs(spark, sf_dir).select("doc_id", values.channel_identifier(said).alias("name"), values.channel_number(number).alias("number"))


@query(f"""SELECT doc_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN false WHEN a IS NULL AND x <> '' AND y <> '' AND x <> y THEN false ELSE true END AS same FROM (
SELECT doc_id, {chosen((None, "1"), 'doc_id')} AS a, {chosen((None, "1", "2"), 'doc_id')} AS b, coalesce({chosen(("a", "", None, "b"), '(doc_id // 6)')}, '') AS x, coalesce({chosen(("a", None, "b"), '(doc_id // 6)')}, '') AS y FROM documents)""")
def val_same_channel(spark, sf_dir):
    d, e = F.col("doc_id"), F.floor(F.col("doc_id") / 6)
    same = values.same_channel(pick((None, "1"), d), pick(("A", "", None, "b"), e), pick((None, "1", "2"), d), pick(("a", None, "B"), e))
    return docs(spark, sf_dir).select("doc_id", same.alias("same"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'LEAK-' || doc_id WHEN 1 THEN doc_id::VARCHAR END AS id, CASE WHEN lang = 'en' THEN '2026-01-02' END AS day FROM documents")
def val_unique_ids(spark, sf_dir):
    k = F.col("doc_id") % 3
    day = F.when(F.col("lang") == "en", "2026-01-02T03:04:05+09:00").otherwise(F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", values.unique_id(F.when(k == 0, "LEAK").when(k == 1, ""), F.when(k < 2, F.col("doc_id"))).alias("id"), values.end_day(day).alias("day"))


ENDINGS = ("com", "net", "org", "onion", "st", "su", "ru", "is", "to", "cc", "sx", "pw", "me")


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE page_id % 4 <> 1 END AS same FROM pages""")
def val_same_place(spark, sf_dir):
    k, host = F.col("page_id") % 4, F.concat(F.lit("forum"), F.col("page_id").cast("string"))
    right = F.when(k == 0, F.concat(F.lit("http://"), host, F.lit(".st/x"))).when(k == 1, F.concat(host, F.lit("9.st"))).when(k == 2, F.concat_ws(" ", F.upper(host))).otherwise("..")
    return table(spark, sf_dir, "pages").select("page_id", values.same_place(F.concat(host, F.lit(".su")), right, ENDINGS).alias("same"))


@query(f"""SELECT doc_id, kind, n_chars % 2 = 0 OR coalesce(kind, '') = 'DB 판매' AS worth FROM (SELECT doc_id, n_chars, {chosen(("DB 판매", "CVE", "", None), 'doc_id')} AS kind FROM documents)""")
def val_worth_a_case(spark, sf_dir):
    kind = pick(("DB 판매", "CVE", "", None), F.col("doc_id"))
    return docs(spark, sf_dir).select("doc_id", kind.alias("kind"), values.worth_a_case(kind, F.col("n_chars") % 2 != 0).alias("worth"))


@query(r"""SELECT page_id, regexp_matches(html, '(?i)(?:^|[^a-z0-9])(?:article|footer)(?:[^a-z0-9]|$)') AND NOT regexp_matches(html, '(?i)\.org(?:[^a-z0-9]|$)|(?:^|[^a-z0-9])advert(?:[^a-z0-9]|$)') AS wanted FROM pages""")
def val_title_wanted(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", values.title_wanted(F.col("html"), ("article", "footer"), (".org", "advert")).alias("wanted"))


@query("""SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['gamma' || doc_id || '구형', 'gamma' || doc_id] WHEN 1 THEN ['leak' || doc_id || 'x', 'leak-' || doc_id] ELSE ['inc7'||doc_id, 'inc-7'||doc_id] END) AS key FROM documents""")
def val_question_keys(spark, sf_dir):
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("Gamma "), n, F.lit(" (구형)"))).when(k == 1, F.concat(F.lit("LEAK-"), n, F.lit(" x"))).otherwise(F.concat(F.lit("INC7"), n))
    return docs(spark, sf_dir).select("doc_id", F.explode(values.question_keys(name)).alias("key"))


#: A cell, a new line, and what comes of them, as told by hand.
CELLS = (
    ("", "구독자 9 (2026-08-28 기준)", "구독자 9 (2026-08-28 기준)"), ("646", "구독자 9", "구독자 9"), ("사람 글\n구독자 8 (2026-08-01 기준)\n12", "구독자 9", "사람 글\n구독자 9\n12"),
    ("구독자 1,440명 (2026.08.04 13:32 GMT+9 기준)", "구독자 9", "구독자 9\n구독자 1,440명 (2026.08.04 13:32 GMT+9 기준)"), ("a\n구독자 9 ", "구독자 9", "a\n구독자 9"), ("x 3건 (최근 6개월)", "y", "y"), ("a", " ", "a"),
)
ADDRESSES = (
    ("abc[.]onion (2026-07-30 확인)", "http://ABC.onion/ · def.onion\nghi.st", "abc[.]onion (2026-07-30 확인)\ndef.onion\nghi.st"), ("a.io", "https://a.io/", "a.io"), (" ", "x.st · y.st", "x.st · y.st"),
    ("a.io", "b.io · b.io/ · c.io", "a.io\nb.io · c.io"), ("a.io", "1.5 no", "a.io"), ("a.io", "", "a.io"),
)


def sql_list(texts):
    return "[" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in texts) + "]"


@query(f"""SELECT doc_id, replace(({sql_list([c[2] for c in CELLS])})[doc_id % {len(CELLS)} + 1], '9', '9' || doc_id) AS size,
    replace(({sql_list([a[2] for a in ADDRESSES])})[doc_id % {len(ADDRESSES)} + 1], '.io', doc_id || '.io') AS addresses FROM documents""")
def val_merged_cells(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    said = lambda told, k, old, new: F.replace(pick([t[k] for t in told], F.col("doc_id")), F.lit(old), new)
    size = lines.with_figure(*[said(CELLS, k, "9", F.concat(F.lit("9"), n)) for k in (0, 1)])
    addresses = lines.with_addresses(*[said(ADDRESSES, k, ".io", F.concat(n, F.lit(".io"))) for k in (0, 1)])
    return docs(spark, sf_dir).select("doc_id", size.alias("size"), addresses.alias("addresses"))
