"""Queues, actors, notices, names, candidate lines and tokens in texts: nulls, ties, and several passes."""

import random

from pyspark.sql import functions as F

from saltmarsh.functions import names, text
from saltmarsh.operators import matching, queues


def test_queue_of_reviews(spark):
    rows = spark.createDataFrame([("a", "미검토", " KR ", "포럼"), ("b", "미검토", None, "포럼"), ("c", "미검토", None, None), ("d", "사건 O", None, None), ("e", "미검토", "US", "x"), (None, "미검토", None, "x"), ("f", None, None, None)], "case string, review string, country string, source string")
    held, judged = spark.createDataFrame([("a",), ("a",), (None,)], "case string"), spark.createDataFrame([("e",)], "case string")
    told = lambda again: sorted((r.case or "", r.reason or "") for r in queues.review_queue(rows, held, judged, again).collect())
    assert told(False) == [("", ""), ("a", queues.HELD), ("b", queues.FORUM), ("c", ""), ("e", queues.JUDGED)]
    assert told(True) == [("", ""), ("a", queues.HELD), ("b", queues.FORUM), ("c", ""), ("e", "")]


def test_actors_tell_only_what_may_be_told(spark):
    schema = "actor int, name string, roles array<string>, countries array<string>, first_seen string, deals string, aliases array<string>"
    rows = [
        (1, "Neo", ["판매자", "친구"], ["러시아", "미기입", "a.b"], "2024-01-02T03:04", "DB\n 판매", ["@neo2", "NEO", "neo2", "acme_fan", "a b", "x@y", "010-1234-5678"]),
        (2, "X", None, None, "soon", "mail me@x.org", None),
        (3, "Y", [], [], None, "-", []),
    ]
    acme = lambda c: F.contains(F.lower(c), F.lit("acme"))
    found = {r.actor: tuple(r)[1:] for r in queues.actor_info(spark.createDataFrame(rows, schema), acme).collect()}
    assert found == {1: (["판매자"], ["러시아"], "2024-01-02", "DB · 판매", ["neo2"], 6), 2: ([], [], None, None, [], 1), 3: ([], [], None, None, [], 0)}


def test_columns_without_a_list_go(spark):
    rows = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "1"}), ("a", None), (None, {"z": "3"})], "kind string, metadata map<string,string>")
    out = queues.allowed_columns(rows, spark.createDataFrame([("a", "x"), ("a", "x")], "kind string, column string"))
    assert sorted((r.kind or "", str(r.metadata), list(r.dropped)) for r in out.collect()) == [("", "{}", ["z"]), ("a", "None", []), ("a", "{'x': '1'}", ["y"]), ("b", "{}", ["x"])]
    assert {(r.kind, r["column"], r.n) for r in queues.dropped_columns(out).collect()} == {("a", "y", 1), ("b", "x", 1), (None, "z", 1)}


def test_names_of_people_and_venues(spark):
    said = {"홍길동": True, "누리병원": False, "John A. Smith": True, "Smith, John": True, "Anne-Marie Neil": True, "Acme Corp": False, "JOHN SMITH": False, "a@b": True, "John 2": False, "x.com": False, "J*hn Smith": False, "John": False, "": False, None: False}
    rows = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", names.like_a_person(F.col("t")).alias("x")).collect()
    assert {list(said)[r.k]: r.x for r in rows} == said
    raw = {"BreachForums (bf.st)": ("BreachForums", "bf"), "NIFLHEIM.World": ("NIFLHEIM", None), "a.onion": ("a.onion", None), "X (원본, 2025 압수)": ("X", None), ".st": (".st", None), None: ("", None)}
    rows = spark.createDataFrame(list(enumerate(raw)), "k int, t string").select("k", names.display_name(F.col("t")).alias("a"), names.domain_head(F.col("t")).alias("b")).collect()
    assert {list(raw)[r.k]: (r.a, r.b) for r in rows} == raw


def test_candidate_lines(spark):
    page = "Home\n• Acme Corp •\r\nacme corp\nab\n" + "one two three four five six seven eight nine ten eleven twelve thirteen fourteen\n2024-01-02\nLeaks\n- Beta"
    rows = spark.createDataFrame([(page,), (None,), ("",)], "t string").select(queues.candidate_lines(F.col("t")).alias("x")).collect()
    assert [list(r.x) for r in rows] == [["Acme Corp", "Beta"], [], []]


def test_answers_to_prepare(spark):
    examples = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4)], "question int")
    evidence = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "question int, hash string")
    answers = spark.createDataFrame([(1, ["b", "a", "b"], False, "now"), (2, ["a"], None, "old"), (3, ["x"], True, "now")], "question int, hashes array<string>, reviewed boolean, model string")
    assert {r.question: r.state for r in queues.to_prepare(examples, evidence, answers, "now").collect()} == {1: "same", 2: "todo", 3: "todo", 4: "empty"}


def test_tokens_in_any_number_of_passes(spark):
    r = random.Random(3)
    tokens = sorted({"".join(r.choices("abc ", k=r.randrange(1, 7))).strip() for _ in range(60)} - {""})
    said = ["".join(r.choices("abcABC 1.", k=40)) for _ in range(50)] + [None, ""]
    want = set()
    for k, t in enumerate(said):
        low = (t or "").lower()
        for token in tokens:
            short = len(token) <= 3 and " " not in token
            around = any(low[i : i + len(token)] == token and not (low[i - 1 : i] if i else "")[-1:].isalnum() and not low[i + len(token) : i + len(token) + 1].isalnum() for i in range(len(low)))
            if around if short else token in low or token in low.replace(" ", ""):
                want.add((k, token))
    texts = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    listed = spark.createDataFrame([(t,) for t in tokens] + [(None,), ("",)], "token string")
    for size in (1 << 20, 25, 1):
        assert {tuple(x) for x in matching.mentioning(texts, listed, size).collect()} == want
    assert matching.mentioning(texts, listed.limit(0)).count() == 0


def test_sanitized_references(spark):
    said = ["&lt;b&gt;bold&lt;/b&gt; &amp; x", "a‮b\x00c", "ﬁ  x", None, "<" + "a" * 500 + ">"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", text.sanitized(F.col("t")).alias("x")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.k)] == ["bold & x", "abc", "fi x", "", said[4]]
