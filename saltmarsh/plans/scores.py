"""Queries: venue scores, cells, timeline, relations and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import mapscore, relations, search, timeline
from saltmarsh.plans.canonical import AS_OF, POSTS_SQL, RELATIONS_SQL, TERRITORIES_SQL, posts, territories
from saltmarsh.plans.canonical import evidence as evidence_view
from saltmarsh.plans.canonical import relations as relations_view
from saltmarsh.plans.registry import query, table

TODAY = "2024-01-31"
AT = f"TIMESTAMP '{AS_OF}'"
SCORE = """((CASE verdict WHEN 'confirmed' THEN 1.0 WHEN 'high' THEN 1.0 WHEN 'unverified' THEN 0.8 WHEN 'low' THEN 0.4 ELSE 0.0 END)
    * (CASE size WHEN 'large' THEN 1.5 WHEN 'medium' THEN 1.2 ELSE 1.0 END))::DECIMAL(18,6)"""
SCOPED = f"scoped AS (SELECT *, {SCORE} AS score FROM posts WHERE NOT excluded AND verdict <> 'false' AND posted_at <= {AT})"
TOUCHED = "touched AS (SELECT s.*, unnest(list_distinct(list_filter([territory, actor], lambda x: x IS NOT NULL))) AS place FROM scoped s)"


def window(a: int, b: int = 0) -> str:
    return f"NOT substituted AND posted_at > {AT} - INTERVAL {a} DAY AND posted_at <= {AT} - INTERVAL {b} DAY"


TOTALS = f"""totals AS (
    SELECT place, count(*) AS hits, sum(score)::DOUBLE AS score, count(*) FILTER ({window(30)}) AS n30, count(*) FILTER ({window(60, 30)}) AS p30,
        coalesce(sum(score) FILTER ({window(7)}), 0)::DOUBLE AS s7, coalesce(sum(score) FILTER ({window(14, 7)}), 0)::DOUBLE AS ps7,
        min(posted_at) FILTER (NOT substituted) AS first_at, max(posted_at) FILTER (NOT substituted) AS last_at, count(*) FILTER (NOT substituted) AS dated
    FROM touched GROUP BY place
)"""
POSTED = f"WITH {POSTS_SQL}, {SCOPED}, {TOUCHED}, {TOTALS}"
INDEX = "(CASE WHEN {x} IS NULL THEN NULL WHEN coalesce({m}, 0) <= 0 THEN 0 ELSE round(100 * ln(1 + {x}) / ln(1 + {m})) END)"
METRICS = f"""here AS (
    SELECT t.id, island, name, CASE WHEN island = 3 THEN coalesce(dated, 0)::DOUBLE ELSE raw END AS raw, posts, threads, coalesce(hits, 0) AS hits, coalesce(score, 0) AS score,
        coalesce(n30, 0) AS n30, coalesce(p30, 0) AS p30, coalesce(s7, 0) AS s7, coalesce(ps7, 0) AS ps7, last_at
    FROM territories t LEFT JOIN totals ON place = t.id
    WHERE NOT (until IS NOT NULL AND {AT}::DATE > (date_trunc('quarter', until) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE)
        AND CASE WHEN since IS NOT NULL THEN since <= {AT}::DATE ELSE true END
), indexed AS (
    SELECT *, {INDEX.format(x="score", m="max(score) OVER (PARTITION BY island)")} AS event_index,
        {INDEX.format(x="raw", m="max(raw) OVER (PARTITION BY island)")} AS by_raw,
        [{", ".join(INDEX.format(x=c, m=f"max({c}) OVER (PARTITION BY island)") for c in ("raw", "posts", "threads"))}] AS parts
    FROM here
), metrics AS (
    SELECT *, (event_index + 20) * (100 + activity) AS adjusted200 FROM (
        SELECT *, CASE WHEN island = 0 THEN round(coalesce(list_avg(list_filter(parts, lambda x: x IS NOT NULL)), 0)) ELSE coalesce(by_raw, 0) END AS activity FROM indexed
    )
)"""
SCORED = f"{POSTED}, {TERRITORIES_SQL}, {METRICS}"


def at():
    return F.lit(AS_OF).cast("timestamp")


def today():
    return F.lit(TODAY).cast("date")


def metrics(spark, sf_dir):
    return mapscore.computed(territories(spark, sf_dir), posts(spark, sf_dir), at(), today())


@query(f"""{SCORED} SELECT id, island, name, hits, score, event_index::BIGINT AS event_index, activity::BIGINT AS activity, adjusted200::BIGINT AS adjusted200,
    (100 + activity) / 200 AS weight, adjusted200 / 200 AS adjusted, CASE WHEN p30 > 0 THEN round((n30 - p30) * 100 / p30, 4) END AS rate,
    CASE WHEN n30 >= 1 THEN '활성' ELSE '관측 중' END AS status, round(s7 - ps7, 6) AS surge, n30, last_at FROM metrics""")
def map_territories(spark, sf_dir):
    return metrics(spark, sf_dir)


@query(f"WITH {POSTS_SQL} SELECT id, {SCORE}::DOUBLE AS score FROM posts")
def map_event_score(spark, sf_dir):
    return posts(spark, sf_dir).select("id", mapscore.event_score().cast("double").alias("score"))


@query(f"WITH {POSTS_SQL} SELECT id, territory, posted_at FROM posts WHERE NOT excluded AND verdict <> 'false' AND posted_at <= {AT}")
def flt_in_scope(spark, sf_dir):
    return posts(spark, sf_dir).where(mapscore.in_scope(at())).select("id", "territory", "posted_at")


@query(f"{POSTED} SELECT * FROM totals")
def map_territory_acc(spark, sf_dir):
    return mapscore.territory_totals(posts(spark, sf_dir), at())


@query(f"""WITH {TERRITORIES_SQL} SELECT id FROM territories WHERE NOT (until IS NOT NULL AND DATE '2023-12-20' > (date_trunc('quarter', until) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE)
AND coalesce(since <= DATE '2023-12-20', false)""")
def map_presence(spark, sf_dir):
    return territories(spark, sf_dir).where(mapscore.present(F.lit("2023-12-20").cast("date"), today())).select("id")


@query(f"""{SCORED} SELECT island, count(*) AS n, sum(hits)::BIGINT AS hits, round(sum(score::DECIMAL(18,6)), 6)::DOUBLE AS score, round(avg(activity))::BIGINT AS mean_activity, sum(adjusted200)::BIGINT AS adjusted200
FROM metrics GROUP BY island""")
def map_islands(spark, sf_dir):
    return mapscore.island_totals(metrics(spark, sf_dir))


TARGETS = f"""{SCORED}, sums AS (SELECT island, sum(adjusted200::BIGINT) / 200 AS s FROM metrics GROUP BY island),
rounded AS (SELECT island, s, round(800 * power(s, 0.6) / sum(power(s, 0.6)) OVER ())::BIGINT AS target FROM sums),
targets AS (SELECT island, (target + CASE WHEN row_number() OVER (ORDER BY s DESC, island) = 1 THEN 800 - sum(target) OVER () ELSE 0 END)::BIGINT AS target FROM rounded)"""


@query(f"{TARGETS} SELECT island, target FROM targets")
def map_island_targets(spark, sf_dir):
    return mapscore.island_targets(metrics(spark, sf_dir))


@query(f"""{TARGETS}, shared AS (SELECT id, island, target, adjusted200 / sum(adjusted200) OVER (PARTITION BY island) AS share FROM metrics JOIN targets USING (island)),
floored AS (SELECT *, greatest(floor(share * target), 1) AS low, round(share * target - floor(share * target), 9) AS rest FROM shared),
placed AS (SELECT *, target - sum(low) OVER (PARTITION BY island) AS over, row_number() OVER (PARTITION BY island ORDER BY rest DESC, id) AS up,
    row_number() OVER (PARTITION BY island, low >= 2 ORDER BY rest, id) AS down FROM floored)
SELECT id, island, (low + CASE WHEN over > 0 AND up <= over THEN 1 WHEN over < 0 AND low >= 2 AND down <= -over THEN -1 ELSE 0 END)::BIGINT AS cells, round(share, 6) AS share FROM placed""")
def map_allocate_cells(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return mapscore.cells(m, mapscore.island_targets(m))


@query(f"{SCORED} SELECT id, round(s7 - ps7, 6) AS surge FROM metrics WHERE n30 > 0 AND s7 - ps7 > 0.0000001 ORDER BY surge DESC, id LIMIT 5")
def map_surge(spark, sf_dir):
    return mapscore.top_surges(metrics(spark, sf_dir), 5)


@query(f"""WITH {POSTS_SQL}, spine AS (SELECT unnest(generate_series(TIMESTAMP '2023-02-01', TIMESTAMP '2024-01-01', INTERVAL 1 MONTH)) AS month)
SELECT strftime(month, '%Y-%m') AS month, count(id) AS n FROM spine LEFT JOIN posts ON date_trunc('month', posted_at) = month AND NOT excluded AND NOT substituted AND verdict <> 'false' AND posted_at <= {AT} GROUP BY month""")
def map_monthly_zero_fill(spark, sf_dir):
    return mapscore.monthly_counts(posts(spark, sf_dir), at())


@query(f"""{POSTED}, placed AS (SELECT place, hits, row_number() OVER (ORDER BY hits DESC, place) AS k FROM totals),
grouped AS (SELECT CASE WHEN k <= 4 THEN place::VARCHAR ELSE 'others' END AS place, sum(hits)::BIGINT AS n, count(*) AS places FROM placed GROUP BY 1)
SELECT place, n, places, round(n * 100 / sum(n) OVER (), 4) AS percent FROM grouped""")
def map_top_shares(spark, sf_dir):
    return mapscore.top_shares(mapscore.territory_totals(posts(spark, sf_dir), at()), "place", "hits", 4)


@query(f"""WITH {POSTS_SQL}, {SCOPED}, counted AS (SELECT actor, territory, count(*) AS n, max(posted_at) AS last_at FROM scoped WHERE actor IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY actor ORDER BY n DESC, last_at DESC, territory) AS place FROM counted""")
def map_activity(spark, sf_dir):
    return mapscore.activity_places(posts(spark, sf_dir), at())


@query(f"""WITH {POSTS_SQL}, {SCOPED}, firsts AS (SELECT territory, id % 97 AS incident, min((posted_at, id)) AS f FROM scoped GROUP BY 1, 2)
SELECT territory, count(*) AS n, max(f)[2] AS latest FROM firsts GROUP BY territory""")
def map_official_latest(spark, sf_dir):
    return mapscore.official(posts(spark, sf_dir), F.col("id") % 97, at())


@query("SELECT event_id AS id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'")
def flt_window(spark, sf_dir):
    return posts(spark, sf_dir).where(mapscore.in_window(at(), 15)).select("id")


HISTORY = "history AS (SELECT o_orderkey AS id, o_custkey % 150 AS territory, o_orderdate AS posted_at FROM orders)"
SNAPS = f"""WITH {HISTORY}, spine AS (
    SELECT unnest(generate_series((SELECT date_trunc('quarter', min(posted_at))::TIMESTAMP FROM history), TIMESTAMP '2002-01-01', INTERVAL 3 MONTH)) AS quarter
), snaps AS (
    SELECT quarter::DATE AS quarter, year(quarter) || '-Q' || quarter(quarter) AS key, (SELECT count(*) FROM history WHERE posted_at < s.quarter + INTERVAL 3 MONTH) AS n,
        (SELECT count(*) FROM (SELECT territory, min(posted_at) AS f FROM history GROUP BY territory) WHERE date_trunc('quarter', f) = s.quarter) AS fresh
    FROM spine s
)"""


def past(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 150).alias("territory"), F.col("o_orderdate").cast("timestamp").alias("posted_at"))


def snaps(spark, sf_dir):
    return timeline.snapshots(past(spark, sf_dir), F.lit("2002-02-15").cast("date"))


@query(f"{SNAPS} SELECT quarter, key, n, fresh, n - lag(n, 4) OVER (ORDER BY quarter) AS delta FROM snaps")
def map_snapshots(spark, sf_dir):
    return snaps(spark, sf_dir)


@query(f"""{SNAPS}, placed AS (SELECT *, row_number() OVER (PARTITION BY year(quarter) ORDER BY abs(quarter(quarter) - 3), quarter(quarter) DESC) AS k FROM snaps)
SELECT year(quarter)::INT AS year, key, n FROM placed WHERE k = 1""")
def map_year_cards(spark, sf_dir):
    return timeline.year_chips(snaps(spark, sf_dir))


@query(f"""{SNAPS} SELECT key, nullif(coalesce(lag(key, 4) OVER (ORDER BY quarter), first(key) OVER (ORDER BY quarter)), key) AS back,
    nullif(coalesce(lead(key, 4) OVER (ORDER BY quarter), (SELECT max(key) FROM snaps)), key) AS ahead FROM snaps""")
def map_year_steps(spark, sf_dir):
    return timeline.year_steps(snaps(spark, sf_dir))


@query(f"{SNAPS}, grown AS (SELECT key, quarter, n - coalesce(lag(n) OVER (ORDER BY quarter), 0) AS added FROM snaps) SELECT key, added FROM grown ORDER BY added DESC, quarter LIMIT 1")
def map_peak(spark, sf_dir):
    return timeline.peak(snaps(spark, sf_dir))


@query(f"""WITH {HISTORY}, counted AS (SELECT territory, count(*) FILTER (posted_at <= TIMESTAMP '1996-01-01 00:00:00') AS n_a, count(*) FILTER (posted_at <= TIMESTAMP '1997-01-01 00:00:00') AS n_b FROM history GROUP BY 1)
SELECT territory, n_a, n_b, n_b - n_a AS added, CASE WHEN n_a > 0 THEN round((n_b - n_a) * 100 / n_a, 4) END AS rate FROM counted WHERE n_b > 0""")
def map_growth(spark, sf_dir):
    return timeline.growth(past(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"))


@query(f"WITH {HISTORY} SELECT territory FROM history GROUP BY territory HAVING min(posted_at) > TIMESTAMP '1995-02-01 00:00:00' AND min(posted_at) <= TIMESTAMP '1997-01-01 00:00:00'")
def map_fresh_ids(spark, sf_dir):
    return timeline.fresh_ids(past(spark, sf_dir), F.lit("1995-02-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"))


LINKS = f"""WITH {POSTS_SQL}, {RELATIONS_SQL}, {TERRITORIES_SQL}, links AS (
    SELECT r.id, n_from, n_to, kind, confidence, CASE WHEN e.relation IS NULL THEN 1 ELSE e.n END AS n, first_at, last_at
    FROM relations r LEFT JOIN (
        SELECT relation, count(*) FILTER (NOT excluded AND verdict <> 'false' AND posted_at <= {AT}) AS n,
            min(posted_at) FILTER (NOT excluded AND verdict <> 'false' AND posted_at <= {AT}) AS first_at, max(posted_at) FILTER (NOT excluded AND verdict <> 'false' AND posted_at <= {AT}) AS last_at
        FROM evidence JOIN posts ON post = id GROUP BY relation
    ) e ON e.relation = r.id
), ends AS (SELECT n_from AS node, n_to AS partner, n FROM links WHERE n > 0 UNION ALL SELECT n_to, n_from, n FROM links WHERE n > 0)"""


def links(spark, sf_dir):
    return relations.counted(relations_view(spark, sf_dir), evidence_view(spark, sf_dir), posts(spark, sf_dir), mapscore.in_scope(at()))


@query(f"{LINKS} SELECT * FROM links")
def rel_count_span(spark, sf_dir):
    return links(spark, sf_dir)


@query(f"{LINKS} SELECT * FROM links WHERE n > 0 AND n_from IN (SELECT id FROM territories WHERE until IS NULL) AND n_to IN (SELECT id FROM territories WHERE until IS NULL)")
def join_relation_ends(spark, sf_dir):
    return relations.among(links(spark, sf_dir), territories(spark, sf_dir).where("until IS NULL"))


@query(f"{LINKS} SELECT id, n FROM links WHERE confidence <> 'estimated'")
def flt_estimated(spark, sf_dir):
    return relations.without_estimated(links(spark, sf_dir), False).select("id", "n")


@query(f"{LINKS} SELECT kind, count(*) AS relations, sum(n)::BIGINT AS n FROM links WHERE n > 0 GROUP BY kind")
def rel_kind_mix(spark, sf_dir):
    return relations.kind_mix(links(spark, sf_dir))


@query(f"{LINKS} SELECT node, sum(n)::BIGINT AS weight, count(DISTINCT partner) AS partners FROM ends GROUP BY node")
def rel_weight(spark, sf_dir):
    return relations.weights(links(spark, sf_dir))


@query(f"{LINKS} SELECT node, count(DISTINCT island) AS islands FROM ends JOIN territories ON id = partner GROUP BY node")
def rel_connected_islands(spark, sf_dir):
    return relations.connected_islands(links(spark, sf_dir), territories(spark, sf_dir))


@query(f"""{LINKS}, kinds AS (SELECT a.island AS island_from, b.island AS island_to, kind, count(*) AS pairs, sum(n) AS n, max(last_at) AS last_at
    FROM links JOIN territories a ON a.id = n_from JOIN territories b ON b.id = n_to WHERE n > 0 GROUP BY 1, 2, 3)
SELECT island_from, island_to, sum(pairs)::BIGINT AS pairs, sum(n)::BIGINT AS n, arg_min(kind, (-n, kind)) AS top_kind, max(last_at) AS last_at FROM kinds GROUP BY 1, 2""")
def rel_island_pairs(spark, sf_dir):
    return relations.island_pairs(links(spark, sf_dir), territories(spark, sf_dir))


@query(f"""{LINKS} SELECT coalesce(a.n_from, b.n_from) AS n_from, coalesce(a.n_to, b.n_to) AS n_to, coalesce(declared, 0) AS declared, coalesce(active, 0) AS active
FROM (SELECT n_from, n_to, count(*) AS declared FROM relations GROUP BY 1, 2) a FULL JOIN (SELECT actor AS n_from, territory AS n_to, count(*) AS active FROM posts WHERE actor <> territory GROUP BY 1, 2) b ON a.n_from = b.n_from AND a.n_to = b.n_to""")
def rel_activity_merge(spark, sf_dir):
    return relations.with_activity(relations_view(spark, sf_dir), posts(spark, sf_dir))


@query(f"{LINKS} SELECT *, row_number() OVER (ORDER BY first_at NULLS LAST, n DESC, id) AS place FROM links WHERE n > 0")
def rel_history(spark, sf_dir):
    return relations.history(links(spark, sf_dir))


@query(f"""{LINKS}, e AS (SELECT node, partner, sum(n) AS n FROM ends GROUP BY 1, 2), first AS (SELECT partner AS node, n, row_number() OVER (ORDER BY n DESC, partner) AS rank FROM e WHERE node = 7),
second AS (SELECT partner AS node, sum(e.n) AS n, arg_max(e.node, (e.n, -rank)) AS via FROM e JOIN first f ON e.node = f.node WHERE partner <> 7 AND partner NOT IN (SELECT node FROM first) GROUP BY partner ORDER BY 2 DESC, 1 LIMIT 16)
SELECT node, 1 AS hop, n::BIGINT AS n, NULL::BIGINT AS via FROM first UNION ALL SELECT node, 2, n::BIGINT, via FROM second""")
def rel_hops(spark, sf_dir):
    return relations.hops(links(spark, sf_dir), 7)


@query(f"{LINKS} SELECT node, sum(n)::BIGINT AS weight FROM ends GROUP BY node ORDER BY weight DESC, node LIMIT 6")
def rel_centers(spark, sf_dir):
    return relations.centers(links(spark, sf_dir))


@query(f"""WITH {TERRITORIES_SQL}, ranked AS (SELECT id, CASE WHEN lower(name) = 'customer#00000001' THEN 0 WHEN starts_with(lower(name), 'customer#00000001') THEN 1 WHEN contains(lower(name), 'customer#00000001') THEN 2
    WHEN id % 9 = 0 AND 'alias customer#00000001' LIKE '%customer#00000001%' THEN 2 END AS rank FROM territories) SELECT id, rank FROM ranked WHERE rank IS NOT NULL""")
def search_match_rank(spark, sf_dir):
    alias = F.when(F.col("id") % 9 == 0, F.array(F.lit("Alias Customer#00000001")))
    rank = search.match_rank(F.col("name"), alias, search.needle(F.lit(" CUSTOMER#00000001 ")))
    return territories(spark, sf_dir).select("id", rank.alias("rank")).where("rank IS NOT NULL")


@query(f"""{LINKS}, seeds AS (SELECT id, CASE WHEN lower(name) = 'customer#000000012' THEN 0 WHEN starts_with(lower(name), 'customer#000000012') THEN 1 ELSE 2 END AS rank FROM territories WHERE contains(lower(name), 'customer#000000012'))
SELECT 'place' AS kind, id, rank FROM seeds
UNION ALL SELECT 'post', p.id, min(rank) FROM posts p JOIN seeds s ON s.id IN (p.territory, p.actor) GROUP BY p.id
UNION ALL SELECT 'relation', r.id, min(rank) FROM relations r JOIN seeds s ON s.id IN (r.n_from, r.n_to) GROUP BY r.id""")
def search_associative(spark, sf_dir):
    return search.associated(territories(spark, sf_dir), posts(spark, sf_dir), relations_view(spark, sf_dir), "Customer#000000012")


@query("""WITH names AS (SELECT p_name AS name, count(*) AS "count" FROM part GROUP BY 1)
SELECT name, least(levenshtein(lower(name), 'blue bolr'), levenshtein(lower(substr(name, 1, 9)), 'blue bolr'))::INT AS distance, "count" FROM names WHERE distance <= 3 ORDER BY distance, "count" DESC, name LIMIT 3""")
def search_nearby(spark, sf_dir):
    return search.nearby(table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("count")), "Blue Bolr")


@query("""WITH newest AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2), placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS place FROM newest)
SELECT * FROM placed WHERE place <= 3""")
def search_recent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return search.recent(rows, "event_type", "ts", "user_id", 3)
