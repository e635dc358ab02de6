"""One query for each operator, over its whole table, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import byte_bpe, chat_format, crf_quality, exact_dedup, html_extract, line_dedup, lm_scoring, packing, permutation_index, prefix_trie, sharding, simhash, token_alignment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_quality.judged(docs, crf_quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=2)


@query
def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.bounded_ring_shards(table(spark, sf_dir, "documents"), shards=40, virtual_nodes=64, epsilon=0.0)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    marked = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    back = chat_format.read_back(chat_format.prefix_targets(talks))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL["op6_prefix_target_chat"] = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), placed AS (
    SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        8 + 8 + 7
        + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
        + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
    FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM placed
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(so_far) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


@query
def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"
    )


@query
def op8_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extracted(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query
def op9_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), with_digest=True)


ORACLE_SQL["op9_progressive_exact_dedup"] = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY norm)
"""


@query
def op10_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    left = line_dedup.drop_site_lines(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.page_lines(F.col("html")))
    return left.select("page_id", "host", "text", "n_lines", "n_dropped")


ORACLE_SQL["op10_site_line_dedup"] = rf"""
WITH bare AS (
    SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.UNSEEN}', ' ', 'g'),
            '[\x20\x09-\x0D]+', ' ', 'g'), '{line_dedup.BLOCK}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g') AS text
    FROM pages
), lined AS (
    SELECT page_id, host, list_filter(list_transform(string_split(
        replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'),
        chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
    FROM bare
), totals AS (SELECT host, count(*) AS pages FROM lined GROUP BY host
), often AS (
    SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) JOIN totals USING (host)
    GROUP BY host, line, pages HAVING count(*) >= 2 AND count(*) > 0.3 * pages
), gone AS (SELECT host, list(line) AS gone FROM often GROUP BY host
), kept AS (
    SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS left_over
    FROM lined LEFT JOIN gone USING (host)
)
SELECT page_id, host, array_to_string(left_over, chr(10)) AS text, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(left_over))::BIGINT AS n_dropped
FROM kept
"""


@query
def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.with_borrowed_heads(table(spark, sf_dir, "conversations")))


ORACLE_SQL["op12_prefix_trie"] = r"""
WITH said AS (
    SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (  -- the table of CRC-32: a byte's remainder by the reversed polynomial
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS rest
    FROM range(256) r(b)
), crcs AS (SELECT list(rest ORDER BY b) AS rests FROM bits
), talks AS (
    SELECT conv_id, list(said ORDER BY k) AS own,
        list_transform(string_split(conv_id::VARCHAR, ''), lambda d: unicode(d)::BIGINT) AS digits
    FROM said GROUP BY conv_id
), heads AS (
    SELECT conv_id, own, conv_id - conv_id % 5 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda x, d: xor(x // 256, rests[xor(x % 256, d) + 1])), 4294967295) % 9 AS h
    FROM talks, crcs
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.own, [])[:a.h], a.own[a.h + 1:]) AS turns FROM heads a LEFT JOIN heads b ON b.conv_id = a.base
), prefixes AS (
    SELECT conv_id, len(turns) AS n, d, turns[:d] AS path FROM rebuilt, unnest(range(len(turns) + 1)) u(d)
), nodes AS (
    SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].text) END AS saved
    FROM prefixes GROUP BY d, path
), children AS (SELECT d - 1 AS d, path[:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), known AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (d, path)
), rolled AS (
    SELECT u.d, path[:u.d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
    FROM known, unnest(range(known.d + 1)) u(d) GROUP BY ALL
)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN rolled r ON r.d = k.d AND r.path = k.path LEFT JOIN nodes p ON p.d = k.d - 1 AND p.path = k.path[:k.d - 1]
"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment(table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
