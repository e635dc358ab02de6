"""Findings of round 3: rare values, longer keys, and work that must not grow faster than the input."""

import random
import re
import time
import unicodedata

import pytest

from pyspark.sql import functions as F

from saltmarsh.functions import posts, text, values, webpages
from saltmarsh.operators import matching, queues, retrieval
from saltmarsh.plans import QUERIES
from saltmarsh.sources import dumps


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("body, want", [("Customer#000010207 Error", "클라우드플레어에 막힙니다"), ("Customer#000010150", "클라우드플레어에 막힙니다"), ("Error 1020", "클라우드플레어 규칙에 막힙니다"), ("error code:1015.", "클라우드플레어가 속도 제한을 겁니다"), (None, "클라우드플레어에 막힙니다")])
def test_codes_are_whole_numbers(spark, body, want):
    assert one(spark, webpages.blocker(F.create_map(F.lit("Server"), F.lit("cloudflare")), F.lit(body).cast("string"))) == want


def test_domains_that_end_like_the_messenger(spark):
    """ment.me and ment.ment.kr hold the letters t.me, but are no channel."""
    found = [one(spark, posts.org_in_text(F.lit(f"at {d} now"))).org for d in ("ment.ment.kr", "lement.ment.kr", "t.me.kr", "x.t.me.kr")]
    assert found == ["ment.ment.kr", "lement.ment.kr", "", ""]
    none = F.lit(None).cast("map<string,string>")
    links = ["https://t.me/x", "https://ment.me/a"]
    assert one(spark, posts.origin(F.array(*[F.lit(u) for u in links]), F.lit(""), none)) == links[1]
    assert one(spark, posts.origin(F.array().cast("array<string>"), F.lit("https://ment.me/abc"), none)) == "https://ment.me/abc"
    assert one(spark, posts.origin(F.array(F.lit("t.me/x")), F.lit("https://t.me/abcdef"), none)) == ""


def test_long_part_numbers_are_not_odd(spark, tmp_path):
    spark.sql("SELECT 1L AS o_orderkey, 'O' AS o_orderstatus, timestamp '1993-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS l_orderkey, p AS l_partkey, n AS l_linenumber, 7.0D AS l_quantity, 'A' AS l_returnflag FROM VALUES (1000000L, 1), (9999999977L, 2), (12345678L, 3) t(p, n)").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(r.what, r.value) for r in QUERIES["snk_checked"](spark, str(tmp_path)).collect()}
    assert found == {("forbidden", "9999999977"), ("key", "odd"), ("length", "quantity: 7")}


def shuffled(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("pass_terms", [1000, 3])
def test_pairs_are_scored_where_the_chunks_lie(spark, pass_terms):
    r = random.Random(3)
    said = [" ".join(r.choices("aa bb cc dd ee".split(), k=r.randrange(0, 9))) for _ in range(60)]
    chunks = spark.createDataFrame(list(enumerate(said)), "document int, body string").repartition(3)
    asked = spark.createDataFrame([("x", "aa bb aa"), ("y", "cc zz"), ("z", "")], "question string, text string")
    n, mean = retrieval.corpus_figures(chunks, F.col("body"))
    held = [t.split() for t in said]
    assert (n, round(mean, 9)) == (sum(map(bool, held)), round(sum(map(len, held)) / sum(map(bool, held)), 9))
    weight = lambda w, t: float(retrieval._idf(n, sum(t in h for h in held))) * retrieval._share(w.count(t), len(w), mean)
    want = {(q, d): sum(weight(w, t) for t in text.split() if t in w) for q, text in asked.collect() for d, w in enumerate(held) if set(text.split()) & set(w)}
    scores = retrieval.lexical_scores(asked, chunks, ["document"], F.col("body"), pass_terms=pass_terms)
    assert shuffled(scores) == 0
    assert {(s.question, s.document): round(s.score, 9) for s in scores.collect()} == {k: round(v, 9) for k, v in want.items()}
    best = retrieval.candidates(scores, ["document"], 7)
    for q in "xy":
        order = sorted((-round(v, 9), d) for (k, d), v in want.items() if k == q)[:7]
        assert [b.document for b in best.where(F.col("question") == q).orderBy("place").collect()] == [d for _, d in order]
    totals = retrieval.term_totals(chunks, F.col("body")).collect()
    assert {x.term: (x.df, round(x.weight, 9)) for x in totals} == {t: (sum(t in h for h in held), round(sum(weight(h, t) for h in held if t in h), 9)) for t in "aa bb cc dd ee".split()}


def test_best_rows_are_held_in_bounds(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HELD", 20)
    rows = [("g", k, 1.0 if k < 300 else 1.0 + 1e-12 * (k % 3)) for k in range(400)] + [(None, k, float(k % 5)) for k in range(50)]
    data = spark.createDataFrame(rows, "question string, document int, score double").coalesce(1)
    kept = retrieval.leading(data, ["question"], ["document"], 4)
    assert kept.count() <= 30 and {r.document for r in kept.where("question = 'g'").collect()} >= {0, 1, 2, 3}
    assert {r.document for r in kept.where("question IS NULL").collect()} == {4, 9, 14, 19}


def test_statements_of_many_tuples(spark):
    """The head is read once a statement: these tuples took minutes when each read its whole statement again."""
    said = "INSERT INTO t (a, b) VALUES " + ",".join(f"({k},'x, {k}')" for k in range(30_000))
    began = time.monotonic()
    rows = dumps.insert_rows(spark.createDataFrame([(said,)], "s string"), "s").collect()
    assert [(r.name, r["columns"], r["values"]) for r in rows[:2]] == [("t", ["a", "b"], ["0", "x, 0"]), ("t", ["a", "b"], ["1", "x, 1"])] and len(rows) == 30_000
    assert time.monotonic() - began < 20


def test_long_texts_are_not_read_for_each_of_their_parts(spark):
    began = time.monotonic()
    words = [f"w{k % 3000}" for k in range(6000)]
    got = one(spark, F.size(values.word_fingerprints(F.split(F.lit(" ".join(words)), " "), "key")))
    assert got == 9000
    lines = [f"Name {k % 9000}" for k in range(20_000)] + ["NAME 1", "last"]
    got = one(spark, queues.candidate_lines(F.lit("\n".join(lines)), most=1 << 30))
    assert got == list(dict.fromkeys(lines[:20_000])) + ["last"]
    assert time.monotonic() - began < 20
    assert one(spark, webpages.total(F.lit("Members online: 45, Members: 7,000 Total; Members: 9"), webpages.MEMBERS)).n == 7000
    assert one(spark, F.size(values.word_fingerprints(F.array().cast("array<string>"), "key"))) == 0 and one(spark, queues.candidate_lines(F.lit(None).cast("string"))) == []


def test_pairs_with_several_shared_keys_come_once_without_a_shuffle_of_pairs(spark):
    rows = spark.createDataFrame([(1, "u", "Acme / Beta", "h", "f"), (1, "u", "Acme / Beta", "h", "f"), (2, "u", "Acme / Beta", None, "f"), (3, "w", "Other", "h", "f")], "id int, url string, org string, handle string, forum string")
    found = matching.duplicate_cases(rows, rows.where("id = 1"))
    assert sorted((r.row, r.case, r["class"]) for r in found.collect()) == [(1, 1, matching.SAME), (2, 1, matching.SAME)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is put together above the join


def test_texts_that_need_no_python_are_spared_it(spark):
    said = ["plain", "é ñ ß Ö", "ﬁ ①", "e\u0301", "日本語、。", "ㅎㅏ", "…", "a\xa0b", None, "", "한글", "\n\t—“x”"]
    got = {r.k: r.x for r in spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", text.nfkc(F.col("t")).alias("x")).collect()}
    assert [got[k] for k in range(len(said))] == [t if t is None else unicodedata.normalize("NFKC", t) for t in said]
    stable = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.fullmatch(text.STABLE, chr(c)))
    assert unicodedata.normalize("NFKC", stable) == stable and unicodedata.normalize("NFKC", stable[::-1]) == stable[::-1]
    spared = spark.createDataFrame([(t,) for t in said[:2]], "t string").where(~F.col("t").rlike(text.STABLE)).count()
    assert spared == 0 and one(spark, text.unescaped_html(F.lit("a &lt;b&gt;"))) == "a <b>"
