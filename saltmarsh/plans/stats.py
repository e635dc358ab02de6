"""Queries: statistics of collected claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.functions.times import local_day
from saltmarsh.operators import stats
from saltmarsh.plans.canonical import ITEMS_SQL, items
from saltmarsh.plans.registry import query, table

DAY = "(posted_at + INTERVAL 9 HOUR)::DATE"


def day() -> F.Column:
    return local_day(F.col("posted_at"))


@query(f"WITH {ITEMS_SQL} SELECT uid, source, posted_at FROM items WHERE is_new AND source = 'src1' AND posted_at >= TIMESTAMP '2026-01-02 00:00:00'")
def src_scan(spark, sf_dir):
    scanned = items(spark, sf_dir).where("is_new AND source = 'src1' AND posted_at >= timestamp'2026-01-02 00:00:00'")
    return scanned.select("uid", "source", "posted_at").orderBy(F.desc("posted_at"))


@query(f"""WITH {ITEMS_SQL} SELECT uid, source, {DAY} AS day, industry FROM items
WHERE source = 'src2' AND country = 'EN' AND {DAY} BETWEEN DATE '2026-01-03' AND DATE '2026-02-15'""")
def src_scan_period(spark, sf_dir):
    rows = stats.between_days(stats.scoped(items(spark, sf_dir), "src2", "EN"), day(), "2026-01-03", "2026-02-15")
    return rows.select("uid", "source", day().alias("day"), F.get_json_object("raw", "$.industry").alias("industry"))


@query(f"WITH {ITEMS_SQL} SELECT source, count(*) AS n, count(*) FILTER (is_new) AS n_new FROM items GROUP BY source")
def agg_counts_by_source(spark, sf_dir):
    return stats.counts_by_source(items(spark, sf_dir))


@query(f"WITH {ITEMS_SQL} SELECT coalesce(strftime({DAY}, '%Y-%m'), '(미상)') AS month, count(*) AS n FROM items GROUP BY 1")
def agg_month(spark, sf_dir):
    return stats.by_month(items(spark, sf_dir), day())


RANKED_SQL = """ranked AS (
    SELECT label, n, row_number() OVER (ORDER BY n DESC, label = '(미상)', label) AS place
    FROM (SELECT coalesce(nullif(trim(actor), ''), '(미상)') AS label, count(*) AS n FROM items GROUP BY 1)
)"""


@query(f"WITH {ITEMS_SQL}, {RANKED_SQL} SELECT label, n, place FROM ranked")
def agg_rank_blank_last(spark, sf_dir):
    return stats.ranked(items(spark, sf_dir), F.col("actor"))


@query(f"""WITH {ITEMS_SQL}, {RANKED_SQL} SELECT CASE WHEN place <= 5 THEN label ELSE 'others' END AS label, least(place, 6) AS place,
    sum(n)::BIGINT AS n, count(*) AS groups FROM ranked GROUP BY 1, 2""")
def agg_topn_others(spark, sf_dir):
    return stats.top_with_others(items(spark, sf_dir), F.col("actor"), 5)


@query(f"WITH {ITEMS_SQL} SELECT count(DISTINCT nullif(trim(actor), '')) AS n FROM items")
def agg_distinct_actor(spark, sf_dir):
    return stats.distinct_values(items(spark, sf_dir), F.col("actor"))


@query(f"WITH {ITEMS_SQL} SELECT industry AS label, count(*) AS n FROM items GROUP BY 1")
def agg_industry_json(spark, sf_dir):
    return stats.json_counts(items(spark, sf_dir), "raw", "industry")


@query(f"""WITH {ITEMS_SQL} SELECT k AS kind, count(*) FILTER (k = CASE WHEN trim(claimed_size) = '' THEN 'blank' WHEN regexp_full_match(trim(claimed_size), '-+') THEN 'dash' ELSE 'value' END) AS n
FROM (SELECT unnest(['value', 'dash', 'blank']) AS k), items GROUP BY k""")
def agg_size_split(spark, sf_dir):
    return stats.size_split(items(spark, sf_dir), F.col("claimed_size"))


@query(f"""WITH {ITEMS_SQL}, lags AS (SELECT round((epoch(found_at) - epoch(posted_at)) / 86400, 1) AS days FROM items WHERE posted_at IS NOT NULL AND found_at IS NOT NULL)
SELECT count(*) AS n, round(median(days), 4) AS median_days, max(days) AS max_days FROM lags""")
def agg_lag_median(spark, sf_dir):
    return stats.discovery_lag(items(spark, sf_dir), F.col("posted_at"), F.col("found_at"))


@query(f"""WITH {ITEMS_SQL} SELECT count(*) AS n, count(*) FILTER ({DAY} BETWEEN DATE '2026-01-10' AND DATE '2026-02-10') AS n_period,
    count(*) FILTER (actor <> '') AS has_actor, count(*) FILTER (claimed_size <> '') AS has_claimed_size, count(*) FILTER (target_org <> '') AS has_target_org FROM items""")
def agg_denominator(spark, sf_dir):
    period = day().between(F.lit("2026-01-10").cast("date"), F.lit("2026-02-10").cast("date"))
    return stats.denominator(items(spark, sf_dir), ["actor", "claimed_size", "target_org"], period)


CASES_SQL = """collected AS (
    SELECT doc_id AS "case", CASE doc_id % 8 WHEN 0 THEN '미검토' WHEN 1 THEN '사건 X' WHEN 2 THEN '' ELSE '사건 O' END AS review
    FROM documents WHERE doc_id % 3 <> 2
), verified AS (
    SELECT doc_id AS "case", CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN '확인됨' WHEN quality = 1 THEN '신뢰성 높음' WHEN toxic = 1 THEN '' ELSE '허위' END AS verdict,
        doc_id % 4 <> 1 AS checked
    FROM labels
)"""


def cases(spark, sf_dir):
    d = F.col("doc_id")
    review = F.when(d % 8 == 0, "미검토").when(d % 8 == 1, "사건 X").when(d % 8 == 2, "").otherwise("사건 O")
    collected = table(spark, sf_dir, "documents").where(d % 3 != 2).select(d.alias("case"), review.alias("review"))
    verdict = F.when((F.col("quality") == 1) & (d % 2 == 0), "확인됨").when(F.col("quality") == 1, "신뢰성 높음").when(F.col("toxic") == 1, "").otherwise("허위")
    checks = F.when(d % 4 != 1, F.array(F.lit("샘플 확인"), F.lit("출처 확인"))).otherwise(F.array(F.lit("출처 확인")))
    return collected, table(spark, sf_dir, "labels").select(d.alias("case"), verdict.alias("verdict"), checks.alias("checks"))


@query(f"""WITH {CASES_SQL}, inside AS (SELECT DISTINCT "case" FROM collected WHERE review NOT IN ('미검토', '사건 X'))
SELECT (SELECT count(*) FROM documents) AS n_items, (SELECT count(*) FROM inside) AS n_collected,
    count(*) FILTER ("case" IN (FROM inside)) AS n_verified,
    count(*) FILTER ("case" IN (FROM inside) AND verdict IN ('확인됨', '신뢰성 높음') AND checked) AS n_confirmed,
    count(*) FILTER ("case" NOT IN (FROM inside)) AS n_outside FROM verified""")
def agg_funnel(spark, sf_dir):
    return stats.funnel(items(spark, sf_dir), *cases(spark, sf_dir))


@query(f"""WITH {CASES_SQL}, inside AS (SELECT DISTINCT "case" FROM collected WHERE review NOT IN ('미검토', '사건 X'))
SELECT CASE WHEN verdict = '' THEN '(미상)' ELSE verdict END AS verdict, "case" IN (FROM inside) AS inside, count(*) AS n FROM verified GROUP BY 1, 2""")
def funnel_verdict_hist(spark, sf_dir):
    return stats.verdict_histogram(*cases(spark, sf_dir))


@query(f"""WITH {CASES_SQL} SELECT "case", review FROM collected WHERE review NOT IN ('미검토', '사건 X')""")
def flt_review_gate(spark, sf_dir):
    return stats.review_gate(cases(spark, sf_dir)[0], F.col("review"))


@query(f"""WITH {CASES_SQL} SELECT v."case", verdict, review FROM verified v JOIN collected c ON v."case" = c."case" WHERE review = '사건 O'""")
def join_semi_verified(spark, sf_dir):
    collected, verified = cases(spark, sf_dir)
    return verified.join(collected.where("review = '사건 O'"), "case").select("case", "verdict", "review")


@query(f"WITH {ITEMS_SQL} SELECT uid, source, '' AS actor FROM items WHERE source = 'src3'")
def flt_hide_actor(spark, sf_dir):
    return stats.hide_unless(items(spark, sf_dir).where("source = 'src3'").select("uid", "source", "actor"), "actor", "src3", "ransom")
