"""Every query of the library gives the rows of its SQL; those without SQL are held against plain Python below."""

import datetime
import decimal
import hashlib
import hmac
import math
import re
import unicodedata

import duckdb
import pytest

from pyspark.sql import functions as F

from saltmarsh import plans
from saltmarsh.functions import classify, review, sizes, text, values
from saltmarsh.operators import events as listed
from saltmarsh.operators import matching, reports
from saltmarsh.operators.order import numbered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", plans.ORACLE_SQL)
def test_query_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_personal_data(spark):
    said = ["a@b.co c_d@e.org", "call 010-1234-5678 or 02-123-4567", "900101-1234567", "10.0.0.1 and 1:2:3:4:5", "on 2024-01-02 only", "account 123-456-7890", "x" * 200_000, "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").select("k", text.personal_masked(text.F.col("t")).alias("m"), text.masked(text.F.col("t")).alias("again")).collect()
    for r in got:
        want, labels = said[r.k], []
        for label, pattern in text.PERSONAL:
            if want is not None:
                left = re.sub(pattern.replace(r"(?:(?<![A-Za-z0-9._%+\-])|\G)", r"(?<![A-Za-z0-9._%+\-])"), label, want) if len(want) < 1000 else want
                labels += [label] if left != want and label not in labels else []
                want = left
        assert (r.m.masked, list(r.m.labels), r.again) == (want, labels, want)
    assert [r.m.masked for r in got][:3] == ["[이메일] [이메일]", "call [전화번호] or [전화번호]", "[주민등록번호]"]


def told(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, t string").select("k", column(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


def test_link_lists(spark):
    said = [text for text, _ in plans.review.LINKS] + [None]
    assert told(spark, said, review.links) == [x.split("|") if x else [] for _, x in plans.review.LINKS] + [[]]


def test_claims_for_display(spark):
    said = ["5천만 건", "1억 2천만", "20 000 000 rows", "1.2M records", "관리자 3명 포함 120만 건", "파일 5개, 12GB", "255GB 유출", "2026년 자료", None]
    assert told(spark, said, sizes.display) == ["5000만", "1.2억", "2000만", "120만", "120만", "12GB", "255GB", None, None]


def test_foreign_claims(spark):
    said = ["US confirmed", "US likely", "US review", "US none", "KR none", "UNKNOWN none", "N/A none", "- none", " none"]
    foreign = told(spark, said, lambda t: classify.foreign(F.split(t, " ")[0], F.split(t, " ")[1]))
    assert foreign == [False, False, True, True, False, False, False, False, False]


def test_whole_names_only(spark):
    pairs = [("(주)가나다라", "가나다라 주식회사", True), ("x (ganada.co.kr)", "https://www.ganada.co.kr/notice", True), ("한국abc대학교", "abc 코리아", False), ("Seoul Bank", "Hana Bank", False), ("Acme Co., Ltd.", "ACME", True), (None, "a", False)]
    for left, right, same in pairs:
        found = matching.same_organisation(spark.createDataFrame([(1, left)], "id int, name string"), spark.createDataFrame([(right,)], "name string"))
        assert (found.count() == 1) == same, (left, right)


def test_texts_that_name_organisations(spark):
    names = ["Acme Co., Ltd.", "X (acme.co.kr)", "Alpha / Beta", "www.ganada.co.kr", "https://shop.lamaba.com", "가나", "SK", None, ""]
    hits = ["포럼: F Acme DB", "acme.co.kr 재게시", "Beta 유출", "ganada 회원", "lamaba 판매", "가나 회원", "SK 텔레콤"]
    misses = ["포럼: XForum https://xforum.onion 이전", "SKY forum", "Darkforums 제휴", "Ltd 공지", "", None]
    tokens = matching.org_tokens(spark.createDataFrame([(n,) for n in names], "name string"))
    found = matching.mentioning(spark.createDataFrame(list(enumerate(hits + misses)), "id int, text string"), tokens)
    assert {r.id for r in found.collect()} == set(range(len(hits)))


def test_compatibility_form(spark):
    said = ["Ｆｕｌｌ　Width", "ﬁle ①", "é́", "ㅎㅏㄴ", " A ", None]
    assert told(spark, said, text.name_key) == [unicodedata.normalize("NFKC", x or "").lower().strip(" ") for x in said]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_of_wide_rows(spark, adaptive):
    """Every place is the row's rank, with columns of the library's own names, many ranges and small ones put together."""
    settings = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 300_000
        rows = spark.range(n).select("id", (F.col("id") * 7919 % n).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("_part"), F.lit("x" * 50).alias("_n")).repartition(7)
        wrong = numbered(rows, F.desc("v")).agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.sum((F.col("place") != n - F.col("v")).cast("int")).alias("wrong")).first()
        assert tuple(wrong) == (n, n, 0)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_months_without_a_time(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "2024-01-02"), (4, "2024-01-03"), (5, "soon")], "id int, at string")
    found = {r.id: (r.month, r.place_in_month, r.in_month) for r in listed.by_month(rows, "at", "id").collect()}
    assert found == {1: (None, 1, 2), 2: (None, 2, 2), 3: ("2024-01", 2, 2), 4: ("2024-01", 1, 2), 5: ("soon", 1, 1)}


def test_keyed_fingerprints(spark):
    said = ["a", "가나 " * 100, "", None]
    for key in ("k", "long key " * 20):
        assert told(spark, said, lambda t: values.fingerprint(t, key)) == [hmac.new(key.encode(), x.encode(), hashlib.sha256).hexdigest() if x else None for x in said]
    assert told(spark, ["a"], lambda t: values.fingerprint(t, "")) == [None]


def test_rounding_of_halves(spark):
    assert told(spark, ["62.5", "2.675", "1.005", "-0.5", "0.285", None], lambda t: values.rounded(t.cast("double"), 2)) == [62.5, 2.68, 1.01, -0.5, 0.29, None]
    assert told(spark, ["62.5", "-2.5", "0.49999999999999994"], lambda t: values.rounded(t.cast("double"))) == [63, -3, 0]


def test_nearest_cells(spark):
    """Points all over the plane, below zero too, go to a cell whose middle no neighbour's middle is nearer than."""
    points = spark.range(4000).select((F.rand(1) * 60 - 30).alias("x"), (F.rand(2) * 60 - 30).alias("y"))
    at = points.withColumn("c", values.cell_at(F.col("x"), F.col("y"), 2.0)).select("x", "y", "c.col", "c.row")
    for r in at.collect():
        gap = lambda col, row: math.dist((r.x, r.y), (2 * 3**0.5 * (col + 0.5 * (row & 1)), 3.0 * row))
        assert gap(r.col, r.row) <= min(gap(r.col + a, r.row + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) + 1e-9


def test_observations_of_unknown_states(spark):
    schema = "uid int, at timestamp, src string, state string, countdown string, expiry timestamp"
    for src, state in (("agg", "gone"), ("else", "연장"), (None, "연장"), ("agg", None)):
        with pytest.raises(Exception, match="unknown"):
            reports.recorded(spark.createDataFrame([(1, None, src, state, None, None)], schema)).collect()
    assert reports.recorded(spark.createDataFrame([], schema)).count() == 0


def test_rechecks_without_a_hidden_list(spark):
    questions = spark.createDataFrame([(1, ["b", "a"]), (2, ["x"]), (3, None)], "question int, prints array<string>")
    shown = spark.createDataFrame([("a", "A", 2), ("b", "B2", 2), ("b", "B1", 1)], "print string, row string, place int")
    found = {r.question: (r.branch, r.row) for r in reports.rechecked(questions, shown, None).collect()}
    assert found == {1: ("shown", "B1"), 2: ("unchecked", None), 3: ("unchecked", None)}
