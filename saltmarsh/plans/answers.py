"""Queries: sentences and their citations, recall over weights, rates of answers, and plans of what to capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import answers, capture
from saltmarsh.plans.registry import query, table

#: Documents as answers; every 4th cites nothing, the others three spans each, of varied place and length.
CITED = r"""texts AS (SELECT doc_id AS answer, coalesce(text, '') AS text FROM documents),
cites AS (SELECT answer, (answer * k * 97) % (length(text) + 1) AS "from", (answer * k * 97) % (length(text) + 1) + 1 + (answer * k) % 700 AS "to", (answer + k) % 5 AS source FROM texts, range(1, 4) r(k) WHERE answer % 4 <> 0),
cut AS (SELECT answer, list_filter(string_split(regexp_replace(text, '([.!?。]\s+|\n+)', '\1' || chr(57344), 'g'), chr(57344)), lambda p: p <> '') AS parts FROM texts),
placed AS (SELECT answer, unnest(parts) AS part, unnest(range(len(parts))) AS k, unnest(list_transform(parts, lambda p, i: coalesce(list_sum(list_transform(parts[:i - 1], lambda q: length(q))), 0))) AS start FROM cut),
pieces AS (SELECT answer, start, start + length(part) AS stop, regexp_replace(part, '^\s+|\s+$', '', 'g') AS text, row_number() OVER (PARTITION BY answer ORDER BY k) - 1 AS place FROM placed WHERE regexp_matches(part, '\S')) """


def cited(spark, sf_dir):
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.explode(F.sequence(F.lit(1), F.lit(3)))
    start = (F.col("answer") * F.col("k") * 97) % (F.length("text") + 1)
    cites = said.where("answer % 4 <> 0").select("answer", "text", k.alias("k")).select("answer", start.alias("start"), (start + 1 + (F.col("answer") * F.col("k")) % 700).alias("end"), ((F.col("answer") + F.col("k")) % 5).alias("source"))
    return said, cites


@query("WITH " + CITED + """SELECT p.answer, p.place, p.text, coalesce(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), []) AS sources
FROM pieces p LEFT JOIN cites c ON c.answer = p.answer AND c."from" < p.stop AND c."to" > p.start GROUP BY ALL""")
def rag_cited_pieces(spark, sf_dir):
    found = answers.cited_pieces(*cited(spark, sf_dir))
    return found.select("answer", F.col("place").cast("long").alias("place"), "text", "sources")


@query()
def rag_sentences(spark, sf_dir):
    return answers.sentences(*cited(spark, sf_dir))


@query("WITH " + CITED + "SELECT answer, answer % 4 <> 0 AND NOT contains(text, 'the') AS grounded FROM texts")
def rag_grounded(spark, sf_dir):
    return answers.grounded(*cited(spark, sf_dir), "the")


WEIGHTS = [0.0, 0.3, 0.5, 2.0]


@query("""WITH candidates AS (SELECT l_orderkey AS question, l_partkey AS document, max(l_quantity) AS base, max(l_discount * 100) AS extra FROM lineitem GROUP BY ALL),
wanted AS (SELECT l_orderkey AS question, min(l_partkey) AS document, CASE WHEN l_orderkey % 3 = 0 THEN 'alias' ELSE 'name' END AS kind FROM lineitem GROUP BY l_orderkey),
scored AS (SELECT question, document, weight, base + weight * extra AS score FROM candidates, (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (2.0::DOUBLE)) w(weight)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question, weight ORDER BY score DESC, document) AS place FROM scored WHERE score > 0)
SELECT kind, weight, count(*) AS n, count(*) FILTER (place <= 3) AS in_m, count(*) FILTER (place <= 1) AS in_k,
    count(*) - count(*) FILTER (place <= 3) AS missed_candidates, count(*) FILTER (place <= 3) - count(*) FILTER (place <= 1) AS missed_ranking
FROM wanted LEFT JOIN ranked USING (question, document) GROUP BY kind, weight""")
def rag_recall_by_weight(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    candidates = lines.groupBy(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("document")).agg(F.max("l_quantity").cast("double").alias("base"), F.max(F.col("l_discount") * 100).cast("double").alias("extra"))
    wanted = lines.groupBy(F.col("l_orderkey").alias("question")).agg(F.min("l_partkey").alias("document")).withColumn("kind", F.when(F.col("question") % 3 == 0, "alias").otherwise("name"))
    return answers.recall_by_weight(candidates, wanted, WEIGHTS, m=3, k=1)


@query("""WITH r AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'answerable' WHEN 'F' THEN 'none' ELSE 'hidden' END AS kind, o_custkey % 3 <> 0 AS grounded, o_orderkey % 7 + 1 AS sentences, o_orderkey % 7 AS cited FROM orders)
SELECT round(sum(cited) FILTER (grounded) / sum(sentences) FILTER (grounded), 3) AS cited_rate, round(count(*) FILTER (kind = 'none' AND NOT grounded) / count(*) FILTER (kind = 'none'), 3) AS none_known,
    round(count(*) FILTER (kind = 'answerable' AND NOT grounded) / count(*) FILTER (kind = 'answerable'), 3) AS answerable_refused, round(count(*) FILTER (kind = 'hidden' AND NOT grounded) / count(*) FILTER (kind = 'hidden'), 3) AS hidden_refused FROM r""")
def rag_answer_rates(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "answerable").when(F.col("o_orderstatus") == "F", "none").otherwise("hidden")
    rows = table(spark, sf_dir, "orders").select(kind.alias("kind"), (F.col("o_custkey") % 3 != 0).alias("grounded"), (F.col("o_orderkey") % 7 + 1).alias("sentences"), (F.col("o_orderkey") % 7).alias("cited"))
    return answers.answer_rates(rows)


QUOTAS = {"korea": 3, "trade": 1, "leak": 2, "forum": 1}


@query("""WITH c AS (SELECT user_id AS channel, event_id AS id, event_type, value FROM events),
korea AS (SELECT channel, 'korea' AS list, row_number() OVER (PARTITION BY channel ORDER BY id) AS place, id FROM c WHERE event_type = 'click' QUALIFY place <= 3),
trade AS (SELECT channel, 'trade' AS list, row_number() OVER (PARTITION BY channel ORDER BY value DESC, id) AS place, id FROM c WHERE value > 10 AND (channel, id) NOT IN (SELECT channel, id FROM korea) QUALIFY place <= 1),
two AS (FROM korea UNION ALL FROM trade),
leak AS (SELECT channel, 'leak' AS list, row_number() OVER (PARTITION BY channel ORDER BY value DESC, id) AS place, id FROM c WHERE event_type <> 'error' AND (channel, id) NOT IN (SELECT channel, id FROM two) QUALIFY place <= 2),
three AS (FROM two UNION ALL FROM leak),
forum AS (SELECT channel, 'forum' AS list, row_number() OVER (PARTITION BY channel ORDER BY id) AS place, id FROM c WHERE (channel, id) NOT IN (SELECT channel, id FROM three) QUALIFY place <= 1)
SELECT channel, list, place::INT AS place, id FROM three UNION ALL SELECT channel, list, place::INT, id FROM forum""")
def chan_capture_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("id"), "event_type", "value")
    by_value = -F.col("value")
    lists = F.array_compact(
        F.array(
            F.when(F.col("event_type") == "click", F.struct(F.lit("korea").alias("list"), F.lit(0.0).alias("rank"))),
            F.when(F.col("value") > 10, F.struct(F.lit("trade").alias("list"), by_value.alias("rank"))),
            F.when(F.col("event_type") != "error", F.struct(F.lit("leak").alias("list"), by_value.alias("rank"))),
            F.struct(F.lit("forum").alias("list"), F.lit(0.0).alias("rank")),
        )
    )
    return capture.capture_plan(rows.select("channel", "id", F.inline(lists)), QUOTAS).select("channel", "list", "place", "id")
